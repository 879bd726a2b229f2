import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from larder.llm.spelling import near_words, signatures, spelling_variants
from larder.runtime import Scratch

SCHEMA = "doc_id long, text string, word string, n long"


def brute_words(rows, every, length, count):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= length and c >= count}


def edits(word, letters):
    for k in range(len(word) + 1):
        for x in letters:
            yield word[:k] + x + word[k:]
            if k < len(word):
                yield word[:k] + x + word[k + 1 :]
        if k < len(word):
            yield word[:k] + word[k + 1 :]


def brute_near(words):
    letters = {x for w in words for x in w}
    return {w: {e for e in edits(w, letters) if e in words and e != w} for w in words}


def brute(rows, every=97, length=5, count=3):
    words = brute_words(rows, every, length, count)
    near, out = brute_near(words), {}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (words[w], len(near[w]), form[w], words.get(form[w]), root)
    return out


def found(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def odd_rows():
    rnd = random.Random(4)
    stems = ["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(4, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "ÀÉÎõü", "ÀÉÎõ×", "Straße", "strasse"]
    rows = []
    for doc in range(120):
        words = []
        for _ in range(60):
            word = stems[int(len(stems) * rnd.random() ** 2)]
            if rnd.random() < 0.3:
                k = rnd.randrange(len(word))
                word = rnd.choice([word[:k] + word[k + 1 :], word[:k] + "b" + word[k + 1 :], word[:k] + "x" + word[k:], word.upper(), word.capitalize()])
            words.append(word)
        rows.append((doc, rnd.choice([" ", ", ", "-", "1"]).join(words), "clash", 1))
    rows += [(None, "abcde abcde", "", 0), (500, None, None, None), (501, "", "", 0), (502, "1 2 .", "", 0), rows[0], rows[0]]
    return rows + [(600, " ".join(["longword", "longwordd"] * 20_000), "", 0)]


@pytest.mark.parametrize("every", [97, 3])
def test_variants_equal_brute_force(spark, every):
    rows = odd_rows()
    got = spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(5), every=every)
    want = brute(rows, every)
    assert len(want) > 50 and any(w[4] != k and want[w[4]][4] == w[4] for k, w in want.items())
    assert found(got) == want


def test_near_words_lose_none(spark):
    """Every edit of some words, among them repeated letters, is found however the bits are dealt."""
    words = sorted({e for w in ("abcab", "aaaaa", "éclair", "zz") for e in edits(w, "abé")} | {"other", "words"})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for parts in (3, 5, 8):
        near = defaultdict(set)
        pairs = near_words(frame, parts).collect()
        for a, b in pairs:
            near[a].add(b)
        assert len(pairs) == sum(map(len, near.values()))
        assert near == {w: o for w, o in brute_near(set(words)).items() if o}
    assert signatures(frame, 5).count() == 10 * len(words)


def test_chains_are_followed_to_their_end(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    text = " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))
    got = found(spelling_variants(spark.createDataFrame([(7, text, "", 0)], SCHEMA), every=1 << 40))
    assert {w: got[w][2] for w in chain} == dict(zip(chain, [*chain[1:], None], strict=True))
    assert {got[w][4] for w in chain} == {"bbbbb"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling_variants(none).collect() == []
    assert spelling_variants(spark.createDataFrame([(1, "one two three", "", 0)], SCHEMA)).columns == spelling_variants(none).columns
    assert near_words(none.select(F.col("word"))).collect() == []


def test_nothing_is_broadcast(spark, monkeypatch):
    """Signatures are 28 times the words that Spark sizes them by: no join may go by its estimate, nor by what it finds while it runs."""
    ran, table = [], Scratch.table

    def noted(self, df):
        df.collect()
        ran.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df)

    monkeypatch.setattr(Scratch, "table", noted)
    rows = [(1, "spell spell spell spelll spelll spelll spelll spelll spelll others others others", "", 0)]
    assert found(spelling_variants(spark.createDataFrame(rows, SCHEMA), every=1 << 40)) == brute(rows, 1 << 40)
    assert [plan for plan in ran if "Broadcast" in plan] == []
    assert sum("SortMergeJoin" in plan for plan in ran) >= 3
