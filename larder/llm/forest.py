"""Approximate nearest neighbours: a forest of hash prefixes.

Each tree writes a vector as a long string of hash symbols, and keeps its strings in one sorted array.
Vectors that share a longer prefix are likelier to be near. A query descends every tree to its
longest-prefix matches, then ascends all trees together, one symbol at a time, until the matching
ranges hold enough candidates; these are compared by true distance.

A symbol is a cross-polytope hash: of a randomly rotated vector, the coordinate of greatest magnitude
and its sign. The index is cut into blocks of vectors, each with its own sorted arrays, and every
query visits every block, so neither a hot prefix nor a group of copies can make a large task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.vectors import best_of, matrix, usable
from larder.runtime import materialize

TREES = 64
SYMBOLS = 4  # symbols in a string; ranges finer than the finest hold hardly anything
BLOCK = 8192  # vectors in a block
ENOUGH, LEAST = 0.15, 1024  # different candidates wanted from a block: a share of its vectors, and at least so many
QUERIES_AT_ONCE = 1024
SAMPLE = 4096  # vectors that the centre is taken from


def rotations(width: int, seed: int = 11) -> np.ndarray:
    """One rotation per tree and symbol, side by side."""
    rng = np.random.default_rng(seed)
    return np.hstack([np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(TREES * SYMBOLS)])


def strings(x: np.ndarray, turned: np.ndarray, bits: int) -> np.ndarray:
    """Each vector's string in each tree, as one number with the first symbol on top."""
    width = x.shape[1]
    out = np.zeros((len(x), TREES), np.uint64)
    for tree in range(TREES):
        for symbol in range(SYMBOLS):
            at = (tree * SYMBOLS + symbol) * width
            y = x @ turned[:, at : at + width]
            peak = np.abs(y).argmax(axis=1)
            code = 2 * peak + (y[np.arange(len(y)), peak] > 0)
            out[:, tree] = (out[:, tree] << np.uint64(bits)) | code.astype(np.uint64)
    return out


class Block:
    """A block's vectors and, per tree, its strings in order."""

    def __init__(self, x: np.ndarray, keys: np.ndarray):
        self.x = x
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, axis=0)

    def ranges(self, keys: np.ndarray, level: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query and tree the range of strings that share the query's first `level` symbols."""
        rest = np.uint64((1 << bits * (SYMBOLS - level)) - 1)
        start, stop = np.empty(keys.shape, np.int64), np.empty(keys.shape, np.int64)
        for tree in range(keys.shape[1]):
            start[:, tree] = np.searchsorted(self.sorted[:, tree], keys[:, tree] & ~rest)
            stop[:, tree] = np.searchsorted(self.sorted[:, tree], keys[:, tree] | rest, side="right")
        return start, stop

    def candidates(self, keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        """For each query the places of its candidates; all places where no prefix leads to enough."""
        n = len(self.x)
        wanted = min(n, max(LEAST, int(ENOUGH * n)))
        found: list[np.ndarray | None] = [None] * len(keys)
        waiting = np.arange(len(keys))
        for level in range(SYMBOLS, 0, -1):
            start, stop = self.ranges(keys[waiting], level, bits)
            for row in np.flatnonzero((stop - start).sum(axis=1) >= wanted):
                near = np.zeros(n, bool)
                for tree in range(TREES):
                    near[self.order[start[row, tree] : stop[row, tree], tree]] = True
                if near.sum() >= wanted:  # trees find many of the same
                    found[waiting[row]] = np.flatnonzero(near)
            waiting = np.array([w for w in waiting if found[w] is None], np.int64)
            if not len(waiting):
                break
        everything = np.arange(n)
        for f in found:
            yield everything if f is None else f


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of each query's k nearest vectors found.

    vectors, queries: vec_id and v, arrays of doubles, one row per id. A vector with the query's id is
    not its candidate. Ties go to the smaller vec_id. Vectors of different lengths are filled with
    zeros. With fewer than k candidates all are returned: blocks of up to LEAST vectors are searched whole.
    """
    spark = vectors.sparkSession
    vectors, queries = materialize(vectors), materialize(queries)
    size = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    asked = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    if not size[0] or not asked[0]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = max(size[1], asked[1])
    bits = max(1, (2 * width - 1).bit_length())
    if bits * SYMBOLS > 64:
        raise ValueError(f"strings of {SYMBOLS} symbols of {bits} bits do not fit 64 bits")
    turned = rotations(width)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    centre = matrix(sample.column(0), width).mean(axis=0)
    blocks, chunks = -(-size[0] // block), -(-asked[0] // QUERIES_AT_ONCE)
    held = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks).cast("long")))
    # Queries travel in packs, one row per pack and block.
    packed = queries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks))).groupBy("chunk").agg(F.collect_list(F.struct("vec_id", "v")).alias("pack"))
    asks = materialize(packed).select("pack", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block"))

    def search(rows: pa.Table, packs: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not rows.num_rows or not packs.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("vec_id")
        ids, x = rows.column("vec_id").to_numpy(), matrix(rows.column("v"), width)
        index = Block(x, strings(x - centre, turned, bits))
        out: list[list[np.ndarray]] = [[], [], []]
        for pack in packs.column("pack").chunks:
            for one in range(len(pack)):
                asked = pack.slice(one, 1).flatten()
                names, q = asked.field("vec_id").to_numpy(), matrix(asked.field("v"), width)
                for name, own, near in zip(names, q, index.candidates(strings(q - centre, turned, bits), bits), strict=True):
                    near = near[ids[near] != name]
                    away = np.sqrt(((x[near] - own) ** 2).sum(axis=1))
                    if len(near) > k:
                        edge = np.partition(away, k - 1)[k - 1]
                        near, away = near[away <= edge], away[away <= edge]
                    best = np.lexsort((ids[near], away))[:k]
                    out[0].append(np.full(len(best), name))
                    out[1].append(ids[near[best]])
                    out[2].append(away[best])
        return pa.Table.from_arrays([pa.array(np.concatenate(c), t.type) for c, t in zip(out, schema, strict=True)], schema=schema)

    found = held.groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(search, "query_id long, vec_id long, score double")
    return best_of(found, k, ascending=True)


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding").where(F.exists("v", lambda x: x != 0))
    return nearest(given, given.where("vec_id % 100 = 0"), 10)


QUERIES = {"op5_nearest": op5_nearest}
SQL: dict[str, str] = {}
