"""Language identification by fusing evidence.

A document's posterior over languages is the product of
- the likelihood of its text, under byte-trigram counts of each language,
- the likelihood of its declared language (markup, metadata) and of its address suffix, each given the language,
- a prior of its host, shrunk towards its domain's, which is shrunk towards the corpus's.

Text models are fitted on a bounded number of distinct texts of each declared language. Languages with too few texts for a model
of their own share one, and a document that it fits best has the language it declares. Everything else is counted over all
documents: text-only posteriors are summed by (host, declared, suffix), and the tables of hosts, domains, declarations and
suffixes are sums of those sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.batches import rows_at_once
from larder.llm.vectors import matrix
from larder.runtime import materialize

FEATURES = 1 << 15
SAMPLE = 4_000  # distinct texts that a language's text model is fitted on, at most
LEAST = 10  # distinct texts that a declared language needs to get a model of its own,
MIN_SHARE = 0.005  # or this share of all distinct texts in a small corpus; others share one model
MODELS = 255  # models of one language, at most: those with the most texts
COPIES = 3  # times that copies of one text count, at most
TEMPER = 0.25  # neighbouring trigrams share letters: each counts as a quarter of an observation
SHRINK = 20.0  # documents that a host's or domain's parent counts for
PIECE = 1 << 19  # bytes of text worked on at once
ROWS = 500  # rows of a batch that are worked on at once
REST = "*"  # the class of languages that share a model; no declaration reads like this

_letters = np.full(256, 32, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _letters[_b] = ord(chr(_b).lower())
    elif _b > 127:
        _letters[_b] = _b


def _trigrams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of bytes at each place, and whether the middle one is a letter's byte."""
    b = _letters[raw].astype(np.uint32)
    mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 15), b[1:-1] != 32


def _pieces(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """Each whole text, between two spaces, in overlapping pieces of bounded size."""
    for k, text in enumerate(texts):
        raw = np.frombuffer(b" " + (text.as_py() or "").encode() + b" ", np.uint8)
        for at in range(0, max(1, len(raw) - 2), size):
            yield k, raw[at : at + size + 2]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


@dataclass
class TextModel:
    """log P(trigram | language), one row per trigram; the last column is uniform: no known language."""

    languages: list[str]
    table: np.ndarray

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log-likelihoods, a row per text, and the number of trigrams about a letter."""
        out, letters = np.zeros((len(texts), len(self.languages) + 1)), np.zeros(len(texts), np.int64)
        group: list[tuple[int, np.ndarray]] = []
        held, size = 0, 4 * PIECE // (len(self.languages) + 1)  # the weights of a piece: a few bytes for each language

        def flush():
            at = np.cumsum([0, *(len(raw) for _, raw in group)])
            features, inside = _trigrams(np.concatenate([raw for _, raw in group]))
            weights = self.table[np.where(inside, features, FEATURES)]  # the row past the end is zero
            for n, (k, _) in enumerate(group):
                span = slice(at[n], at[n + 1] - 2)  # trigrams that reach into the next text are left out
                out[k] += weights[span].sum(axis=0, dtype=np.float64)
                letters[k] += np.count_nonzero(inside[span])

        for k, raw in _pieces(texts, size):
            group.append((k, raw))
            held += len(raw)
            if held >= size:
                flush()
                group, held = [], 0
        if group:
            flush()
        return out * TEMPER, letters


def primary(declared: Column) -> Column:
    """`de-AT` and `DE_at` are `de`; empty is null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(declared)), "^([a-z]+)", 1), F.lit(""))


def fit_text_model(docs: DataFrame, text: str, declared: str, sample: int = SAMPLE) -> TextModel:
    """Trigram counts per declared language, each of the `sample` distinct texts of least hash.

    Which languages get a model of their own is decided on all documents: the MODELS commonest of those that have LEAST
    distinct texts, or MIN_SHARE of all where that is less. The other declared languages share the model REST.
    Copies of a text count COPIES times at most.
    """
    given = docs.where(F.col(declared).isNotNull() & (F.length(text) > 0)).select(F.col(text).alias("text"), F.col(declared).alias("declared"), F.xxhash64(text).alias("hash"))
    texts = materialize(given.groupBy("declared", "hash").agg(F.least(F.count("*"), F.lit(COPIES)).alias("copies")))
    sizes = texts.groupBy("declared").agg(F.count("*").alias("texts"))
    whole = texts.count()
    least = min(LEAST, whole * MIN_SHARE)
    # MODELS rows at most.
    own = sizes.where(F.col("texts") >= least).orderBy(F.desc("texts"), "declared").limit(MODELS).collect()
    known = docs.sparkSession.createDataFrame([(r.declared, r.texts) for r in own], "declared string, texts long")
    rest = whole - sum(r.texts for r in own)
    classed = texts.join(F.broadcast(known), "declared", "left").select(
        "declared", "hash", "copies", F.when(F.col("texts").isNull(), F.lit(REST)).otherwise(F.col("declared")).alias("class"), F.coalesce("texts", F.lit(rest)).alias("texts")
    )
    # Hashes are even: those below twice the wanted share hold the `sample` least ones, and little else moves.
    share = (F.col("hash") / F.lit(2.0**64) + 0.5) * F.col("texts")
    near = classed.where(share <= 2 * sample + 100)
    turn = F.expr("row_number() over (partition by class order by hash, declared)")
    drawn = materialize(near.withColumn("turn", turn).where(F.col("turn") <= sample).drop("turn", "texts"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # of the drawn texts only
        for batch in batches:
            names, hashes = batch.column("declared").to_pylist(), batch.column("hash").to_pylist()
            new = []
            for k, key in enumerate(zip(names, hashes, strict=True)):
                if key not in seen:
                    seen.add(key)
                    new.append(k)
            yield batch.take(pa.array(new, pa.int64()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, copies = batch.column("class").to_pylist(), batch.column("copies").to_pylist()
            for k, raw in _pieces(batch.column("text")):
                features, inside = _trigrams(raw)
                own = sums.setdefault(names[k], np.zeros(FEATURES, np.int64))
                own += copies[k] * np.bincount(features[inside], minlength=FEATURES)
        for name, own in sums.items():
            yield pa.RecordBatch.from_pydict({"class": [name], "counts": [own.tobytes()]})

    def add(parts: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(c, np.int64) for c in parts.column("counts").to_pylist()), np.zeros(FEATURES, np.int64))
        return pa.table({"class": parts.column("class").slice(0, 1), "counts": [total.tobytes()]})

    schema = "class string, counts binary"
    # At most `sample` rows for each of MODELS + 1 classes.
    picked = given.join(F.broadcast(drawn), ["declared", "hash"]).select("declared", "hash", "class", "copies", "text")
    picked = picked.mapInArrow(once, picked.schema).dropDuplicates(["declared", "hash"])
    rows = sorted(picked.mapInArrow(count, schema).groupBy("class").applyInArrow(add, schema).collect())
    table = np.zeros((FEATURES + 1, len(rows) + 1), np.float32)
    for k, row in enumerate(rows):
        counts = np.frombuffer(row.counts, np.int64) + 0.05
        table[:-1, k] = np.log(counts / counts.sum())
    table[:-1, -1] = -np.log(FEATURES)
    return TextModel([r["class"] for r in rows], table)


def _softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def score_texts(rows: DataFrame, text: str, model: TextModel) -> DataFrame:
    """Replaces the text by `likelihood` and text-only `posterior` (arrays, last entry: other) and `letters`."""
    kept = [c for c in rows.columns if c != text]
    given = rows.select(*kept, text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            got, letters = model.score(batch.column(batch.num_columns - 1))
            lists = [pa.array(x.tolist(), pa.list_(pa.float64())) for x in (got, _softmax(got))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists, pa.array(letters)], [*kept, "likelihood", "posterior", "letters"])

    none = F.array().cast("array<double>")
    return given.mapInArrow(score, given.select(*kept, none.alias("likelihood"), none.alias("posterior"), F.lit(0).cast("long").alias("letters")).schema)


def _summed(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(column)[k]) for k in range(n)])


def _total(column: str | Column) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda a, x: a + x)


def _shrunk(own: Column, parent: Column) -> Column:
    """(own sums + SHRINK * parent's distribution), normalised; the parent where there are no own sums."""
    return F.coalesce(F.zip_with(own, parent, lambda s, p: (s + SHRINK * p) / (_total(own) + SHRINK)), parent)


def _evidence(combined: DataFrame, column: str, n: int) -> DataFrame:
    """For each value of a column log P(value | language), with one added observation per language and value."""
    table = combined.where(F.col(column).isNotNull()).groupBy(column).agg(_summed("mass", n).alias("sums"))
    per_language = table.agg(_summed("sums", n).alias("all"), F.count("*").alias("values"))
    likely = F.zip_with("sums", "all", lambda s, t: F.log((s + 1) / (t + F.col("values") + 1)))
    return table.join(F.broadcast(per_language), how="cross").select(column, likely.alias(f"{column}_evidence"))


def _given(docs: DataFrame, keys: list[Column], text: str, declared: str | None, suffix: str | None, host: str | None) -> DataFrame:
    """keys, declared, suffix, host and text of docs; null where a row lacks that evidence."""

    def optional(name: str | None) -> Column:
        return docs[name].cast("string") if name else F.lit(None).cast("string")

    return docs.select(
        *keys,
        primary(optional(declared)).alias("declared"),
        F.nullif(F.lower(optional(suffix)), F.lit("")).alias("suffix"),
        F.nullif(F.lower(optional(host)), F.lit("")).alias("host"),
        docs[text].alias("text"),
    )


EVIDENCE = ("host", "declared", "suffix")


def _bias(combined: DataFrame, n: int) -> DataFrame:
    """of_host, of_declared, of_suffix and bias: the log of what all evidence but the text adds to each language.

    combined: text-only posteriors summed (`mass`) by host, declared and suffix.
    """
    combined = combined.withColumn("domain", F.substring_index("host", ".", -2))
    corpus = combined.agg(_summed("mass", n).alias("corpus_sums"))
    corpus = corpus.select(F.transform("corpus_sums", lambda s: (s + 1) / (_total("corpus_sums") + n)).alias("corpus"))
    hosts = combined.where("host is not null").groupBy("host").agg(_summed("mass", n).alias("host_sums"))
    domains = combined.where("domain is not null").groupBy("domain").agg(_summed("mass", n).alias("domain_sums"))
    bias = combined.join(F.broadcast(corpus), how="cross").join(domains, "domain", "left").join(hosts, "host", "left")
    for column in ("declared", "suffix"):
        bias = bias.join(_evidence(combined, column, n), column, "left")
    prior = F.transform(_shrunk(F.col("host_sums"), _shrunk(F.col("domain_sums"), F.col("corpus"))), lambda p: F.log(p))
    for column in ("declared", "suffix"):
        prior = F.coalesce(F.zip_with(prior, f"{column}_evidence", lambda a, b: a + b), prior)
    return bias.select(*[F.col(c).alias(f"of_{c}") for c in EVIDENCE], prior.alias("bias"))


def identify(
    docs: DataFrame,
    keys: list[str],
    text: str = "text",
    declared: str | None = None,
    suffix: str | None = None,
    host: str | None = None,
    sample: int = SAMPLE,
) -> DataFrame:
    """The key columns of every row, and language, confidence, letters and accepted.

    declared, suffix, host: names of string columns, null where a row lacks that evidence.
    A row is accepted if its text holds a letter, a known language is likelier than none, and that
    language has over half of the posterior. Where the model that rare languages share is likeliest, the
    language is the declared one; without a declaration there is none. Null and empty texts, and those without letters, have no
    language. Repeated rows give repeated rows; an empty table gives an empty result. Key columns
    should not be named like an added one.
    """
    rows = _given(docs, [docs[c].alias(f"key_{n}") for n, c in enumerate(keys)], text, declared, suffix, host)
    model = fit_text_model(rows, "text", "declared", sample)
    n = len(model.languages) + 1
    scored = materialize(score_texts(rows, "text", model))
    bias = _bias(materialize(scored.groupBy(*EVIDENCE).agg(_summed("posterior", n).alias("mass"))), n)
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in EVIDENCE]
    fused = scored.join(bias, same[0] & same[1] & same[2], "left").withColumn("total", F.zip_with("likelihood", "bias", lambda a, b: a + b))
    best = F.array_max("total")
    named = F.array(*[F.col("declared") if x == REST else F.lit(x) for x in model.languages], F.lit(None).cast("string"))
    fused = fused.select(
        *[F.col(f"key_{k}").alias(c) for k, c in enumerate(keys)],
        F.when(F.col("letters") > 0, F.try_element_at(named, F.array_position("total", best).cast("int"))).alias("language"),
        (1 / _total(F.transform("total", lambda x: F.exp(x - best)))).alias("confidence"),
        "letters",
    )
    return fused.withColumn("accepted", F.col("language").isNotNull() & (F.col("confidence") > 0.5))


def keep_identified(docs: DataFrame, text: str = "text", declared: str = "lang", host: str = "source", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that identify accepts, as they are: each row is judged by its own text and evidence.

    Texts are read three times and never move: once for the models, once for the sums of the evidence, and once to
    judge a row beside the few sums that concern it.
    """
    rows = _given(docs, [], text, declared, None, host)
    with rows_at_once(docs.sparkSession, 2 * ROWS):
        model = fit_text_model(rows, "text", "declared", sample)
        n = len(model.languages) + 1
        summed = score_texts(rows, "text", model).groupBy(*EVIDENCE).agg(_summed("posterior", n).alias("mass"))
        bias = materialize(_bias(materialize(summed), n))
    evidence = _given(docs, [docs[c].alias(f"__{k}") for k, c in enumerate(docs.columns)], text, declared, None, host)
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in EVIDENCE]
    # The sums are a row for each combination of evidence: Spark knows the table's size, and broadcasts it if it is small.
    beside = evidence.join(bias, same[0] & same[1] & same[2], "left").select(*[f"__{k}" for k in range(len(docs.columns))], "declared", "bias", "text")
    names = docs.columns
    known = np.array([x != REST for x in model.languages] + [False])
    rest = np.array([x == REST for x in model.languages] + [False])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            got, letters = model.score(batch.column("text"))
            total = got + matrix(batch.column("bias"), n)
            best = total.argmax(axis=1)
            confidence = _softmax(total)[np.arange(len(best)), best]
            named = known[best] | (rest[best] & batch.column("declared").is_valid().to_numpy(zero_copy_only=False))
            kept = pa.array(named & (letters > 0) & (confidence > 0.5))
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in batch.columns[:-3]], names)

    return beside.mapInArrow(judge, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return identify(docs, ["doc_id"], "text", "lang", None, "source")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of evidence: markup language, the address's country part, hosts within domains."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    host = F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1))
    visible = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&\w+;", " ")
    rows = pages.select(
        "page_id",
        visible.alias("text"),
        F.regexp_extract("html", r"""(?i)<html[^>]*\slang\s*=\s*["']?([\w-]+)""", 1).alias("declared"),
        F.regexp_extract("url", r"://[^/?#]*/([a-z]{2})/", 1).alias("section"),
        F.substring_index(host, ".", -1).alias("top"),
        host.alias("host"),
    )
    rows = rows.withColumn("suffix", F.when(F.col("section") != "", F.col("section")).otherwise(F.col("top")))
    return identify(rows, ["page_id"], "text", "declared", "suffix", "host")


QUERIES = {"op3_language_id": op3_language_id, "page_languages": page_languages}
SQL: dict[str, str] = {}
