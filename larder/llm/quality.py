"""Quality classifier: document statistics, random Fourier features, ridge, isotonic calibration.

Random Fourier features turn a Gaussian kernel over standardised statistics into a plain inner
product. The ridge weights solve normal equations whose sums each task adds up for its own rows; only
those sums, of fixed size, leave it. Scores are calibrated by isotonic regression on labelled rows
that took no part in the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.runtime import materialize

STATISTICS = [
    "log_bytes", "log_words", "log_lines", "word_bytes", "line_words", "distinct_words", "distinct_lines", "upper", "lower", "digit",
    "space", "non_ascii", "end_marks", "exclamations", "dollars_percents", "stars_ampersands_hashes", "bars", "brackets", "other_marks",
    "words_with_inner_mark", "all_caps_words", "top_word", "short_words", "long_words", "repeated_pairs",
]
FOURIER = 256  # random features
WIDTH = 4.0  # of the Gaussian kernel, in standard deviations
RIDGE = 1e-3  # per labelled row
BINS = 2048  # score bins that isotonic regression sees
FITS = 48  # tasks that the normal equations are summed in

#: Byte classes: what a byte counts as.
_KINDS = np.full(256, 10, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b > 127:
        _KINDS[_b] = 4
    elif _c.isupper():
        _KINDS[_b] = 0
    elif _c.islower():
        _KINDS[_b] = 1
    elif _c.isdigit():
        _KINDS[_b] = 2
    elif _c.isspace():
        _KINDS[_b] = 3
    else:
        _KINDS[_b] = next((5 + k for k, group in enumerate((".,;:?", "!", "$%", "*&#", "|", "()[]{}<>")) if _c in group), 11)


def statistics_of(text: str) -> list[float]:
    """The statistics above, of a whole text; all zero for an empty one."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_KINDS[np.frombuffer(raw, np.uint8)], minlength=12) / len(raw)
    lines = [x for x in raw.split(b"\n") if x]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    n = len(words)
    last = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
    return [
        np.log1p(len(raw)), np.log1p(n), np.log1p(len(lines)), lengths.mean(), min(n / len(lines), 200.0), len(counts) / n,
        len(set(lines)) / len(lines), kinds[0], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], kinds[9],
        kinds[10], kinds[11], float(np.isin(_KINDS[last], (6, 7, 8, 9, 10, 11)).mean()), sum(w.isupper() for w in words) / n,
        max(counts.values()) / n, float((lengths <= 2).mean()), float((lengths >= 12).mean()), 1 - pairs / max(1, n - 1),
    ]


def add_statistics(docs: DataFrame, text: str, statistics: str = "statistics") -> DataFrame:
    """Replaces the text by an array of doubles."""
    kept = [c for c in docs.columns if c not in (text, statistics)]
    given = docs.select(*[docs[c] for c in kept], F.coalesce(docs[text], F.lit("")).alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([statistics_of(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], statistics])

    return given.mapInArrow(count, given.select(*kept, F.array().cast("array<double>").alias(statistics)).schema)


@dataclass
class Scorer:
    """Standardise, project to random cosines, weigh, calibrate."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    @classmethod
    def drawn(cls, mean: np.ndarray, spread: np.ndarray, seed: int = 7) -> Scorer:
        rng = np.random.default_rng(seed)
        directions = rng.normal(size=(len(mean), FOURIER)) / WIDTH
        return cls(mean, spread, directions, rng.uniform(0, 2 * np.pi, FOURIER), np.zeros(FOURIER + 1), (np.zeros(1), np.full(1, 0.5)))

    def features(self, statistics: np.ndarray) -> np.ndarray:
        scaled = np.clip((statistics - self.mean) / self.spread, -8, 8)
        waves = np.sqrt(2 / FOURIER) * np.cos(scaled @ self.directions + self.phases)
        return np.hstack([waves, np.ones((len(waves), 1))])

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return self.features(statistics) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(statistics), *self.knots)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def isotonic(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; points of the non-decreasing fit, one per pool, at the pool's mean place."""
    pools: list[list[float]] = []
    for x, y, w in zip(at, mean, weight, strict=True):
        pools.append([x * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    x, y, w = np.array(pools).T
    return x / w, y / w


def fit(labelled: DataFrame) -> Scorer:
    """labelled: statistics, label (0 or 1) and calibrates (boolean). Without labels every score is 0.5."""
    n = len(STATISTICS)
    moments = labelled.agg(
        F.count("*"), *[F.avg(F.col("statistics")[k]) for k in range(n)], *[F.stddev_pop(F.col("statistics")[k]) for k in range(n)]
    ).first()
    if not moments[0]:
        return Scorer.drawn(np.zeros(n), np.ones(n))
    mean, spread = np.array(moments[1 : n + 1], float), np.array(moments[n + 1 :], float)
    scorer = Scorer.drawn(mean, np.where(spread > 1e-9, spread, 1.0))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOURIER + 1, FOURIER + 3))
        for batch in batches:
            z, y = scorer.features(_matrix(batch.column(0))), batch.column(1).to_numpy().astype(float)
            sums[:, : FOURIER + 1] += z.T @ z
            sums[:, FOURIER + 1] += z.T @ y
            sums[0, FOURIER + 2] += len(y)
        if sums[0, FOURIER + 2]:
            yield pa.RecordBatch.from_pydict({"part": list(range(FOURIER + 1)), "sums": [row.tobytes() for row in sums]}, pa.schema([("part", pa.int32()), ("sums", pa.binary())]))

    def add_parts(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in parts.column("sums").to_pylist())
        return pa.table({"part": parts.column("part").slice(0, 1), "sums": [total.tobytes()]})

    fitted = labelled.where("not calibrates").select("statistics", "label").coalesce(FITS)
    schema = "part int, sums binary"
    rows = sorted(fitted.mapInArrow(add_up, schema).groupBy("part").applyInArrow(add_parts, schema).collect())
    if not rows:
        return scorer
    sums = np.array([np.frombuffer(r.sums) for r in rows])
    gram, target, count = sums[:, : FOURIER + 1], sums[:, FOURIER + 1], sums[0, FOURIER + 2]
    scorer.weights = np.linalg.solve(gram + RIDGE * count * np.eye(FOURIER + 1), target)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = scorer.raw(_matrix(batch.column(0)))
            place = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": place, "raw": raw, "label": batch.column(1).cast(pa.float64())})

    told = labelled.where("calibrates").select("statistics", "label").mapInArrow(bins, "bin int, raw double, label double")
    points = sorted(told.groupBy("bin").agg(F.avg("raw"), F.avg("label"), F.count("*")).collect())  # at most BINS
    if points:
        _, at, mean_label, weight = np.array(points, float).T
        # Half a label of each kind at the ends keeps scores off 0 and 1.
        x, y = isotonic(at, mean_label, weight)
        total = weight.sum()
        scorer.knots = (x, (y * total + 0.5) / (total + 1))
    else:
        scorer.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return scorer


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", learns: Column | None = None) -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) and predicted of every row.

    labels: doc_id and quality; null ids and qualities are left out, and ids without a document too.
    learns: a condition on doc_id that labelled rows have to meet. Only whole texts enter a score. Null
    texts count as empty, and are scored like any other; repeated rows give repeated rows.
    """
    rows = materialize(add_statistics(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), "text"))
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if learns is not None:
        known = known.where(learns)
    # One fifth of the documents calibrates. Texts, not ids, decide, so that copies stay on one side.
    side = F.pmod(F.xxhash64("statistics"), F.lit(5)) == 0
    labelled = materialize(rows.join(known, "doc_id").select("statistics", "label", side.alias("calibrates")))
    scorer = fit(labelled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(_matrix(batch.column(1))) if batch.num_rows else [], pa.float64())], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "statistics").mapInArrow(score, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def remainder(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a doc_id have no remainder, and count as not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score_quality(docs, labels, learns=remainder() != 1)
    return scored.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op8_quality": op8_quality}
SQL: dict[str, str] = {}
