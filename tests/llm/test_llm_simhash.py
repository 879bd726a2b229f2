import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from larder.llm.simhash import connected, keep_one, linked_pairs, near_duplicates


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Smallest id reachable, by comparing everything with everything."""
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in prints}


def test_trie_join_finds_all_pairs():
    rng = np.random.default_rng(1)
    for n in (1, 2, 60, 1500):
        values = rng.integers(0, 2**64, size=max(1, n // 8), dtype=np.uint64)[rng.integers(0, max(1, n // 8), n)]
        for _ in range(2):
            values = values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        values = np.unique(values)
        want = {(i, int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= 2) if i < j}
        got = [(int(i), int(j)) for a, b in linked_pairs(values, values, 2, 0) for i, j in zip(a, b, strict=True)]
        assert len(got) == len(set(got))
        assert set(got) == want


def test_long_chains_are_one_group(spark):
    chain = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 200), (200, 300), (100, 300)], "a long, b long"))
    got = {r.node: r.root for r in connected(chain).collect()}
    assert got == {n: 1 for n in range(1, 61)} | {n: 100 for n in (100, 200, 300)}


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {k: fingerprint(t) for k, t in texts.items()}
    want = groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {k: (f"{prints[k]:016x}", want[k]) for k in texts}


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(7, None, "x"), (3, "", "y"), (5, " \n", "z"), (None, "", "w"), (9, "One two three four", "a"), (9, "One two three four", "b"), (12, "one TWO three four", "c"), (None, "only here", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in near_duplicates(docs).collect())
    assert got == sorted([("7", "3"), ("3", "3"), ("5", "3"), ("None", "3"), ("9", "9"), ("9", "9"), ("12", "9"), ("None", "None")])
    kept = sorted(str(r.doc_id) for r in keep_one(docs).collect())
    assert kept == ["3", "9", "None", "None"]
    assert keep_one(docs).columns == docs.columns
    assert near_duplicates(docs.where("false")).collect() == []
