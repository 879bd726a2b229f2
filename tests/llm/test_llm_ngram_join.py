import random
import re
import tracemalloc
from fractions import Fraction

import numpy as np
import pytest

from larder.llm import ngram_join
from larder.llm.ngram_join import build_trie, grams_of, needed, ngram_classes, prefix_of, trie_links

SCHEMA = "doc_id long, text string, component_id string, n int"
J = Fraction(85, 100)


def brute_set(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(found) < words:
        return frozenset([" ".join(found)] if found else [])
    return frozenset(" ".join(found[k : k + words]) for k in range(len(found) - words + 1))


def brute(rows, similarity=J, words=4):
    """(doc_id, size, component) of every row, by comparing all sets."""
    sets = [brute_set(r[1], words) for r in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * similarity.denominator >= len(sets[i] | sets[j]) * similarity.numerator:
                root[find(i)] = find(j)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return sorted(((r[0], len(sets[k]), least.get(find(k))) for k, r in enumerate(rows)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(rnd, words, share):
    return [f"new{rnd.randrange(10**6)}" if rnd.random() < share else w for w in words]


def near_copies(seed, groups=6, each=40, boiler=25):
    """Groups of edited copies on both sides of the threshold, documents that share a passage, and odd rows."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, at = [], 0
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([12, 60, 250]))]
        for _ in range(each):
            rows.append((at, " ".join(edited(rnd, base, rnd.choice([0, 0.005, 0.02, 0.05]))), "x", 1))
            at += 1
    passage = [rnd.choice(vocabulary) for _ in range(100)]
    for _ in range(boiler):
        rows.append((at, " ".join(passage + [rnd.choice(vocabulary) for _ in range(40)]), "x", 1))
        at += 1
    rnd.shuffle(rows)
    odd = [(None, rows[0][1], "", 0), (None, "alone and without an id here", "", 0), (9000, None, None, None), (9001, "", "", 0), (9002, " \t\n", "", 0)]
    odd += [(9003, "one two", "", 0), (9004, "ONE\vtwo", "", 0), (9005, "one two three four", "", 0), (9006, "one two", "", 0), (9003, "other words than that", "", 0)]
    return rows + odd + [rows[3], rows[3]]


@pytest.mark.parametrize("sets", [512, 16])
def test_classes_equal_brute_force(spark, monkeypatch, sets):
    """Also where families are cut to many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", sets)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    rows = near_copies(5)
    assert found(ngram_classes(spark.createDataFrame(rows, SCHEMA).repartition(6))) == brute(rows)


def test_group_without_a_common_centre(spark, monkeypatch):
    """Each text differs from the next in one word of a row of edits: only neighbours link, across all blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([f"v{j}" if j < 5 * k and j % 5 == 0 else w for j, w in enumerate(base)]), "", 0) for k in range(40)]
    assert found(ngram_classes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_other_words_and_similarity(spark):
    rows = near_copies(8, groups=3, each=20)
    for words, similarity in ((1, Fraction(1, 2)), (5, Fraction(4, 5)), (4, Fraction(1))):
        got = ngram_classes(spark.createDataFrame(rows, SCHEMA), words=words, similarity=similarity)
        assert found(got) == brute(rows, similarity, words)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ngram_classes(none).collect() == []
    assert found(ngram_classes(spark.createDataFrame([(3, "a b c d e", "", 0)], SCHEMA))) == [(3, 2, 3)]
    blank = [(1, "", "", 0), (2, None, "", 0)]
    assert found(ngram_classes(spark.createDataFrame(blank, SCHEMA))) == [(1, 0, 1), (2, 0, 2)]


def test_long_texts_are_cut_at_white_space(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"w{rnd.randrange(500)}" for _ in range(60_000)]
    rows = [(1, " ".join(words), "", 0), (2, " ".join(words[:-200]), "", 0), (3, "x" * 300_000 + " tail of it", "", 0)]
    whole = grams_of(rows[0][1])
    monkeypatch.setattr(ngram_join, "PIECE", 1000)
    assert (grams_of(rows[0][1]) == whole).all()
    assert found(ngram_classes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_trie_walks_lose_no_link():
    draw = np.random.default_rng(3)
    for turn in range(60):
        base = draw.choice(400, 80, replace=False)
        sets = []
        for _ in range(draw.integers(2, 40)):
            kept = base[draw.random(80) > draw.choice([0.0, 0.03, 0.1, 0.5])]
            sets.append(np.unique(np.concatenate([kept, draw.integers(1000, 9000, draw.integers(0, 9))])).astype(np.uint64))
        sets = list({s.tobytes(): s for s in sets if len(s)}.values())
        walks = draw.random(len(sets)) < (1.0 if turn % 2 else 0.4)
        root = list(range(len(sets)))

        def find(k, root=root):
            while root[k] != k:
                k = root[k]
            return k

        links = trie_links(sets, np.array([len(s) for s in sets]), walks, J)
        for i, j in links:
            assert len(np.intersect1d(sets[i], sets[j])) >= needed(len(sets[i]), len(sets[j]), J)
            root[find(i)] = find(j)
        for i in range(len(sets)):
            for j in range(i):
                if (walks[i] or walks[j]) and len(np.intersect1d(sets[i], sets[j])) * 100 >= 85 * len(np.union1d(sets[i], sets[j])):
                    assert find(i) == find(j)


def test_trie_shares_common_beginnings():
    rows = [np.array(r) for r in ([0, 1, 2], [0, 1, 2, 3], [0, 1, 5], [4])]
    root = build_trie(rows, np.array([3, 4, 3, 1]))
    assert len(root.grams) == 0 and [(c.low, c.high) for c in root.children] == [(0, 3), (3, 4)]
    shared = root.children[0]
    assert shared.grams.tolist() == [0, 1] and shared.remains == 2 and shared.least == 3
    assert [(c.low, c.high, c.grams.tolist()) for c in shared.children] == [(0, 2, [2]), (2, 3, [5])]


def test_prefixes_are_long_enough():
    for n in range(1, 300):
        least = min(n, -(-85 * n // 100))
        assert prefix_of(n, J) == n - least + 1


def test_families_end_where_sizes_do(spark, monkeypatch):
    """A passage that texts of very different sizes share ties none of them; what could link stays together."""
    rnd = random.Random(11)
    passage = [f"p{k}" for k in range(30)]
    rows, at = [], 0
    for size in (40, 80, 160, 320):
        rest = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
        for k in range(4):
            rows.append((at, " ".join(passage + rest[: size - k]), "", 0))
            at += 1
    seen = []

    def spied(shared, families):
        seen.append(sorted(r[0] for r in families.groupBy("root").count().select("count").collect()))
        return placed(shared, families)

    placed = ngram_join._placed
    monkeypatch.setattr(ngram_join, "_placed", spied)
    assert found(ngram_classes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert seen == [[4, 4, 4, 4]]


def test_every_link_lies_in_a_family():
    """The level of the larger set's size is one that the smaller set goes to."""
    for similarity in (J, Fraction(1, 2), Fraction(1)):
        p, q = similarity.numerator, similarity.denominator
        steps = 2 / max(-np.log(p / q), 1 / 32)
        for n in range(1, 120):
            for pos in range(prefix_of(n, similarity)):
                most = (n - pos) * (p + q) // p - n
                for m in range(n, 260):
                    if (n - pos) >= needed(n, m, similarity):
                        assert m <= most and int(np.log(n) * steps) <= int(np.log(m) * steps) <= int(np.log(most) * steps)


def test_what_is_left_meets_at_once_where_it_is_little(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    calls = []
    monkeypatch.setattr(ngram_join, "connected", lambda links, real=ngram_join.connected: calls.append(1) or real(links))
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([f"v{j}" if j < 5 * k and j % 5 == 0 else w for j, w in enumerate(base)]), "", 0) for k in range(40)]
    assert found(ngram_classes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert len(calls) == 3  # families, what blocks leave, the result


@pytest.mark.parametrize("looked, few", [(0, 8), (512, 0)])
def test_stars_come_first_where_much_is_left(spark, monkeypatch, looked, few):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    monkeypatch.setattr(ngram_join, "LOOKED", looked)
    monkeypatch.setattr(ngram_join, "FEW", few)
    rows = near_copies(9, groups=3)
    assert found(ngram_classes(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_classes_take_little_of_the_driver(spark):
    draw = np.random.default_rng(7)
    hot = draw.integers(0, 2**63, 5).astype(np.uint64)
    sets = [np.unique(np.concatenate([hot[: 1 + k % 5], draw.integers(0, 2**63, 50).astype(np.uint64)])) for k in range(200)]
    df = spark.createDataFrame([(k, bytearray(g.tobytes())) for k, g in enumerate(sets)], "node long, grams binary")
    tracemalloc.start()
    classes = ngram_join.hot_classes(df)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = np.bincount(np.concatenate([ngram_join._bucket(g) for g in sets]).astype(np.int64), minlength=ngram_join.BUCKETS)
    limit = counts.mean() + 6 * np.sqrt(counts.mean()) + 8
    assert (classes == np.where(counts > limit, np.minimum(1 + 8 * np.log2(np.maximum(counts / limit, 1)), 255), 0).astype(np.uint8)).all()
    assert (classes > 0).any() and peak < 24 << 20
