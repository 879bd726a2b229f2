"""SimHash near-duplicates: fingerprints, a self-join of their binary trie, and connected groups.

The sorted distinct fingerprints are a binary trie: a node is a range that shares its leading bits.
The join walks pairs of nodes downwards, adds up the bits in which the two paths differ, and drops a
pair once that exceeds the error budget. Its top is cut at a fixed depth: each task gets one pair of
subtries whose prefixes are near enough, so a fingerprint goes to as many tasks as it has near
prefixes, and all of a task's memory is its subtries plus a bounded frontier.

Only one link per task and fingerprint leaves a task (a spanning forest), however many pairs link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.columns import unused
from larder.runtime import Scratch, materialize

SHINGLE, SEED, BUDGET = 3, 42, 2
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
TOP = 6  # bits that name a subtrie
LEAF = 24  # subtries whose sizes multiply to at most this are compared directly
FRONTIER = 1 << 19  # node pairs held at once


def fingerprint_of(text: str, words: int, seed: int) -> int:
    """Bit k is set if it is set in over half of the hashes of all runs of `words` words, repeats included."""
    from xxhash import xxh64_intdigest

    found = text.encode().translate(LOWER).split()  # splits at exactly the six ASCII white-space bytes
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.cumsum(lengths) - lengths
    ends = (starts + lengths - 1)[words - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends, strict=False)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", fingerprint: str = "fingerprint", words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Replaces the text by a 64-bit fingerprint, as a signed long. Null texts count as empty: fingerprint zero."""
    kept = [c for c in docs.columns if c not in (text, fingerprint)]
    given = docs.select(*[docs[c] for c in kept], F.coalesce(docs[text], F.lit("")).alias("__text"))

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint_of(t.as_py(), words, seed) for t in batch.column(batch.num_columns - 1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made.view(np.int64))], [*batch.schema.names[:-1], fingerprint])

    return given.mapInArrow(of_rows, given.drop("__text").withColumn(fingerprint, F.lit(0).cast("long")).schema)


def _mask(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def linked_pairs(left: np.ndarray, right: np.ndarray, budget: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of sorted values that differ in at most `budget` bits. left is right for a self-join (i < j).

    `depth` leading bits are known to be walked: all of left share them, all of right share them.
    """
    same = left is right
    first = int(_mask(left[:1] >> np.uint64(64 - depth), right[:1] >> np.uint64(64 - depth))[0]) if depth else 0
    # A node pair: ranges [a0, a1) and [b0, b1), bits walked, bits that differ so far.
    stack = [tuple(np.array([x], np.int64) for x in (0, len(left), 0, len(right), depth, first))]
    while stack:
        a0, a1, b0, b1, bit, err = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [tuple(x[:half] for x in (a0, a1, b0, b1, bit, err)), tuple(x[half:] for x in (a0, a1, b0, b1, bit, err))]
            continue
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (bit >= 64)
        if small.any():
            yield from _compare(left, right, a0[small], a1[small], b0[small], b1[small], budget, same)
        a0, a1, b0, b1, bit, err = (x[~small] for x in (a0, a1, b0, b1, bit, err))
        if not len(a0):
            continue
        am, bm = _split(left, a0, a1, bit), _split(right, b0, b1, bit)
        children = [
            (x0, x1, y0, y1, bit + 1, err + differ)
            for x0, x1, y0, y1, differ in ((a0, am, b0, bm, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1), (am, a1, bm, b1, 0))
        ]
        joined = [np.concatenate(x) for x in zip(*children, strict=True)]
        keep = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[5] <= budget)
        if same:  # of two mirrored node pairs keep one
            keep &= joined[0] <= joined[2]
        if keep.any():
            stack.append(tuple(x[keep] for x in joined))


def _split(values: np.ndarray, start: np.ndarray, stop: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the given bit turns from 0 to 1 in each sorted range, by bisection on all ranges at once."""
    shift = (63 - bit).astype(np.uint64)
    low, high = start.copy(), stop.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        one = ((values[np.minimum(middle, len(values) - 1)] >> shift) & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, middle, high)
        low = np.where(open_ & ~one, middle + 1, low)
    return low


def _compare(left, right, a0, a1, b0, b1, budget, same) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    width = b1 - b0
    count = (a1 - a0) * width
    start = 0
    while start < len(count):  # pieces of bounded size; equal values at the deepest level can be many
        stop = max(start + 1, int(np.searchsorted(np.cumsum(count[start:]), FRONTIER * 2)) + start)
        n = count[start:stop]
        pair = np.repeat(np.arange(start, stop), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = a0[pair] + at // width[pair], b0[pair] + at % width[pair]
        near = _mask(left[i], right[j]) <= budget
        if same:
            near &= i < j
        if near.any():
            yield i[near], j[near]
        start = stop


def forest(size: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of `size` nodes the smallest node it is connected with; pairs are merged as they come."""
    root = np.arange(size)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            high, low = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            np.minimum.at(root, high, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def trie_links(values: DataFrame, budget: int = BUDGET, top: int = TOP) -> DataFrame:
    """Links (a, b), a < b, that connect all pairs of distinct longs within `budget` differing bits.

    Not all pairs: per task a spanning forest of them, which connects the same groups.
    values: one column of distinct longs. Empty in, empty out.
    """
    near = [[j for j in range(1 << top) if (i ^ j).bit_count() <= budget] for i in range(1 << top)]
    column = values.columns[0]
    prefix = F.shiftrightunsigned(F.col(column), 64 - top).cast("int")
    others = F.element_at(F.array(*[F.array(*[F.lit(j) for j in row]) for row in near]), prefix + 1)
    dealt = values.select(F.col(column).alias("value"), prefix.alias("own"), F.explode(others).alias("other")).select(
        "value", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")
    )

    def join(rows: pa.Table) -> pa.Table:
        value = rows.column("value").to_numpy().astype(np.int64).view(np.uint64)
        own, p, q = rows.column("own").to_numpy(), rows.column("p")[0].as_py(), rows.column("q")[0].as_py()
        left = np.sort(value[own == p])
        right = left if p == q else np.sort(value[own == q])
        everyone = left if p == q else np.concatenate([left, right])
        shift = 0 if p == q else len(left)
        found = ((i, j + shift) for i, j in linked_pairs(left, right, budget, top)) if len(left) and len(right) else ()
        root = forest(len(everyone), found)
        child = np.flatnonzero(root != np.arange(len(root)))
        signed = everyone.view(np.int64)
        a, b = signed[root[child]], signed[child]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("p", "q").applyInArrow(join, "a long, b long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """Columns node, root: root is the smallest node that links lead to, for every node of a link.

    Alternates two steps until nothing changes: every node's larger neighbours, then every node's
    smaller ones, are tied to its smallest neighbour. A node's neighbours are reduced by min, never
    gathered. Each round is written to the shared folder, and the one before it deleted.
    """

    def smallest(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))

    scratch = Scratch(links.sparkSession)
    edges = scratch.table(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Now edges point from the larger to the smaller end.
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        tied = down.join(smallest(down), "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
        after = scratch.table(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        scratch.drop(edges)
        edges = after
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _smallest(marked: DataFrame, key: str, budget: int) -> DataFrame:
    """fingerprint and the smallest `key` of the group that links connect it with; null if there is none."""
    distinct = marked.groupBy("fingerprint").agg(F.min(key).alias("least"))
    groups = connected(trie_links(distinct.select("fingerprint"), budget))
    owners = distinct.join(groups.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"
    )
    owners = materialize(owners)
    # Only groups of several fingerprints are brought together; the others know their smallest key.
    several = owners.join(owners.where("root <> fingerprint").select("root").distinct(), "root", "left_semi")
    least = several.groupBy("root").agg(F.min("least").alias("smallest"))
    return owners.join(least, "root", "left").select("fingerprint", F.coalesce("smallest", "least").alias("smallest"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE, seed: int = SEED, budget: int = BUDGET
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest doc_id of the group that links of at most `budget` differing bits
    connect, the row itself included. Null and empty texts have fingerprint zero and link like others.
    A null doc_id names no group: its row is fingerprinted and links, and its component_id is null only
    if nothing else in the group has an id. Repeated rows give repeated rows. Other columns are not read.
    """
    given = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    marked = materialize(fingerprints(given, words=words, seed=seed))
    named = _smallest(marked, "doc_id", budget).withColumnRenamed("smallest", "component_id")
    return marked.join(named, "fingerprint", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE, seed: int = SEED, budget: int = BUDGET
) -> DataFrame:
    """The rows of docs that stay: of each group of near_duplicates one document, that with the smallest doc_id.

    A document is an id and a text: rows that repeat an id with another text are documents of their own (the
    smaller hash of a text first), and of rows that repeat both one stays. Rows without a doc_id can't be named
    as copies, and stay. Columns are those of docs.
    """
    own, other, turn = unused(docs, "__id", "__hash", "__turn")
    hashed = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    given = docs.where(docs[doc_id].isNotNull()).select(F.struct(docs[doc_id].alias("id"), hashed.alias("hash")).alias("key"), docs[text].alias("text"))
    marked = materialize(fingerprints(given, words=words, seed=seed))
    stays = _smallest(marked, "key", budget).select(F.col("smallest.id").alias(own), F.col("smallest.hash").alias(other)).distinct()
    kept = docs.join(stays, (F.col(own) == docs[doc_id]) & (F.col(other) == hashed))
    # The join has brought equal documents together: this orders the repeats of one, and moves nothing.
    ordered = [F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])]
    first = kept.withColumn(turn, F.row_number().over(Window.partitionBy(own, other).orderBy(*ordered))).where(F.col(turn) == 1)
    return first.drop(own, other, turn).unionByName(docs.where(docs[doc_id].isNull()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_simhash": op10_simhash}
SQL: dict[str, str] = {}
