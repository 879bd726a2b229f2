"""Exact top-k by inner product, on a pivot-distance index.

With one more coordinate that brings all indexed vectors to one norm, the largest inner product is the
smallest Euclidean distance. Each vector is keyed by its nearest pivot and its distance from it; a
pivot's vectors in order of distance are cut into annuli of bounded size. For a query at distance d
from a pivot, nothing in an annulus [low, high] is nearer than the gap between d and that interval, so
an annulus whose gap exceeds the query's k-th distance so far cannot matter; a query with fewer than k
results so far has no such bound. Queries visit annuli by
growing gap, a few times more each round, until the next gap ends the search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.vectors import best_of, matrix, usable
from larder.runtime import Scratch, materialize

PIVOTS = 32
SAMPLE = 4096  # vectors that pivots are chosen from
RINGS = 256  # distance steps per pivot whose counts are kept
ANNULUS = 2048  # vectors in an annulus, where one step does not hold more
QUERIES_AT_ONCE = 2048
GROWTH = 8  # annuli visited: 1, then 8 more, 64 more, ...
SLACK = 1e-6  # relative; covers rounding of distances


def choose_pivots(vectors: DataFrame, width: int, pivots: int, sample: int) -> np.ndarray:
    """Farthest-first over a sample picked by a hash of ids: each pivot is the vector farthest from those before."""
    drawn = vectors.orderBy(F.xxhash64("first"), "first").limit(sample).select("v").toArrow()
    points = matrix(drawn.column(0), width)
    chosen = [points.mean(axis=0)]
    away = np.linalg.norm(points - chosen[0], axis=1)
    for _ in range(min(pivots, len(points)) - 1):
        chosen.append(points[int(away.argmax())])
        away = np.minimum(away, np.linalg.norm(points - chosen[-1], axis=1))
    return np.array(chosen)


def _distances(x: np.ndarray, lift: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From lifted vectors (x, lift) to pivots (p, 0)."""
    square = (x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1) + (lift * lift)[:, None]
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Annuli:
    """The index's directory, of at most PIVOTS x RINGS entries."""

    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray
    of_ring: np.ndarray  # (pivot, ring) -> annulus
    parts: np.ndarray  # hash parts an annulus is cut into

    @classmethod
    def of(cls, counts: list[tuple[int, int, int, float, float]], pivots: int, size: int) -> Annuli:
        """counts: (pivot, ring, vectors, least and greatest distance)."""
        entries: list[list] = []
        of_ring = np.zeros((pivots, RINGS), np.int64)
        for pivot, ring, n, low, high in sorted(counts):
            if not (entries and entries[-1][0] == pivot and entries[-1][3] + n <= size):
                entries.append([pivot, low, high, 0])
            entries[-1][1:] = [min(entries[-1][1], low), max(entries[-1][2], high), entries[-1][3] + n]
            of_ring[pivot, ring] = len(entries) - 1
        p, low, high, n = (np.array(x) for x in zip(*entries, strict=True))
        return cls(p.astype(int), low.astype(float), high.astype(float), n.astype(int), of_ring, np.maximum(1, -(-n // size)).astype(int))


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integers: floating point where every sum stays below 2^53, else 64-bit integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q @ x.T).astype(np.int64) if bound < 2**53 else q.astype(np.int64) @ x.astype(np.int64).T


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, sample: int = SAMPLE, annulus: int = ANNULUS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k vectors of largest inner product.

    vectors, queries: vec_id and v, arrays of whole numbers as doubles, one row per id. A vector with the
    query's id is not its candidate. Ties go to the smaller vec_id; with fewer than k candidates all are
    returned. Vectors of different lengths are filled with zeros. Exact while scores fit 64 bits.
    Equal vectors are one index entry with their k + 1 smallest ids, which is all that a result can need.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    vectors, queries = materialize(vectors), materialize(queries)
    shape = vectors.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.count("*")).first()
    if not shape[2] or queries.isEmpty():
        return empty
    width, most = max(1, shape[0], queries.agg(F.max(F.size("v"))).first()[0]), shape[1]
    # Equal vectors: the window keeps k + 1 ids per task before any row moves.
    ordered = vectors.withColumn("turn", F.expr("row_number() over (partition by v order by vec_id)")).where(F.col("turn") <= k + 1)
    classes = ordered.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("first", F.col("ids")[0])
    classes = materialize(classes)
    points = choose_pivots(classes, width, pivots, sample)
    reach = 2 * math.sqrt(most) + float(np.linalg.norm(points, axis=1).max()) + 1e-9
    step = reach / RINGS

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), width)
            away = _distances(x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0)), points)
            nearest = away.argmin(axis=1)
            radius = away[np.arange(len(x)), nearest]
            ring = np.minimum(radius / step, RINGS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(radius), pa.array(ring)], [*batch.schema.names, "pivot", "radius", "ring"])

    keyed = materialize(classes.mapInArrow(key, "v array<double>, ids array<long>, first long, pivot int, radius double, ring int"))
    counts = keyed.groupBy("pivot", "ring").agg(F.count("*"), F.min("radius"), F.max("radius")).collect()  # at most PIVOTS x RINGS
    annuli = Annuli.of([tuple(r) for r in counts], len(points), annulus)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = annuli.of_ring[batch.column("pivot").to_numpy(), batch.column("ring").to_numpy()]
            part = batch.column("first").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((part % annuli.parts[at].astype(np.uint64)).astype(np.int64)), batch.column("ids"), batch.column("v")], ["annulus", "part", "ids", "v"])

    index = materialize(keyed.mapInArrow(place, "annulus long, part long, ids array<long>, v array<double>"))
    asked = queries.count()
    chunks = max(1, -(-asked // QUERIES_AT_ONCE))
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)))
    scratch = Scratch(spark)
    best = None
    done, width_of_round = 0, 1
    while done < len(annuli.pivot):
        stop = min(len(annuli.pivot), done + width_of_round)
        visits = _visits(queries, best, k, annuli, points, width, most, done, stop)
        if done:
            visits = scratch.table(visits)
            if visits.isEmpty():
                scratch.drop(visits)
                break
        found = _search(visits, index, width, k, annuli)
        better = scratch.table(best_of(found if best is None else found.unionByName(best.drop("rank")), k, ascending=False))
        scratch.close(better)  # what the round read is done with
        best = better
        done, width_of_round = stop, width_of_round * GROWTH
    return best


def _visits(queries: DataFrame, best: DataFrame | None, k: int, annuli: Annuli, points: np.ndarray, width: int, most: float, start: int, stop: int) -> DataFrame:
    """query_id, v, chunk, annulus and part for the annuli from start to stop in each query's order that can still matter."""
    if best is None:
        open_ = queries.withColumn("kth", F.lit(None).cast("long"))
    else:
        # Fewer than k results bound nothing: such a query visits all of this round's annuli.
        kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        open_ = queries.join(kth, queries["vec_id"] == kth["query_id"], "left").drop("query_id")
    bounded = best is not None

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column("v"), width)
            own = _distances(q, np.zeros(len(q)), points)[:, annuli.pivot]
            gap = np.maximum(np.maximum(annuli.low - own, own - annuli.high), 0)
            order = np.argsort(gap, axis=1, kind="stable")[:, start:stop]
            row = np.repeat(np.arange(len(q)), order.shape[1])
            at = order.ravel()
            keep = np.ones(len(at), bool)
            if bounded:
                # |q - x|^2 = |q|^2 + most - 2 <q, x>: the k-th score is a distance that gaps are held against.
                kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(float)
                square = (q * q).sum(axis=1)
                limit = np.where(np.isnan(kth), np.inf, square + most - 2 * kth)
                rounding = SLACK * (1 + square + most)
                keep = gap[row, at] ** 2 <= (limit + rounding)[row]
            row, at = row[keep], at[keep]
            n = annuli.parts[at]
            row, at = np.repeat(row, n), np.repeat(at, n)
            part = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            picked = pa.array(row)
            for a in range(0, len(row), 4096):
                rows = picked.slice(a, 4096)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(rows), batch.column("v").take(rows), batch.column("chunk").take(rows), pa.array(at[a : a + 4096]), pa.array(part[a : a + 4096])],
                    ["query_id", "q", "chunk", "annulus", "part"],
                )

    return open_.mapInArrow(choose, "query_id long, q array<double>, chunk long, annulus long, part long")


def _search(visits: DataFrame, index: DataFrame, width: int, k: int, annuli: Annuli) -> DataFrame:
    """query_id, vec_id and score: each visit's k best. A task holds one part of an annulus and one chunk of queries."""
    chunks = visits.select(F.col("annulus").alias("a"), F.col("part").alias("p"), F.col("chunk").alias("c")).distinct()
    rows = index.join(chunks, (F.col("annulus") == F.col("a")) & (F.col("part") == F.col("p")))
    rows = rows.select("ids", "v", *[F.col(x).alias(y) for x, y in zip("apc", ("annulus", "part", "chunk"), strict=True)])

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        q, x, names = matrix(asked.column("q"), width), matrix(held.column("v"), width), asked.column("query_id").to_numpy()
        ids = held.column("ids").to_pylist()
        by_id = np.argsort([i[0] for i in ids], kind="stable")
        ids, x = [ids[i] for i in by_id], x[by_id]
        scores = inner_products(q, x)
        # The k + 1 best classes hold the k best ids, one of which may be the query's own.
        take = min(k + 1, len(ids))
        out: list[tuple[int, int, int]] = []
        for row, name in zip(scores, names.tolist(), strict=True):
            edge = np.partition(row, len(row) - take)[len(row) - take]
            near = np.flatnonzero(row >= edge)
            near = near[np.argsort(-row[near], kind="stable")][:take]
            found = sorted((-int(row[c]), i) for c in near for i in ids[c] if i != name)[:k]
            out += [(name, i, -s) for s, i in found]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], schema=schema)

    keys = ["annulus", "part", "chunk"]
    return visits.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    whole = given.withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("double")))
    return top_inner_products(whole, whole.where("vec_id % 50 = 0"), 5)


QUERIES = {"op2_top_k": op2_top_k}

SQL = {
    "op2_top_k": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""
}
