import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from larder.llm import licenses, line_dedup
from larder.llm.licenses import TEMPLATES, Scanner, bands_for, find_licenses, scan_texts, shingles_of, words_of
from larder.llm.line_dedup import remove_lines, repeated_lines


def brute(rows, least=1):
    lines = []
    for doc, text in rows:
        for k, line in enumerate(text.split("\n") if doc is not None and text is not None else ()):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))
            if len(words) >= max(1, least):
                lines.append(((doc, k), words))
    lines.sort(key=lambda x: x[0])
    out, lists = set(), defaultdict(list)
    for i, (place, words) in enumerate(lines):
        shared = defaultdict(int)
        for w in words:
            for j in lists[w]:
                shared[j] += 1
            lists[w].append(i)
        if any(5 * n >= 4 * (len(words) + len(lines[j][1]) - n) and lines[j][0] < place for j, n in shared.items() if j != i):
            out.add(place)
    return out


def made_up(seed=2, docs=300):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rnd.sample(vocabulary, 12) for _ in range(6)]
    rows = []
    for i in range(docs):
        lines = []
        for _ in range(rnd.randint(0, 4)):
            words = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                words[rnd.randrange(12)] = rnd.choice(vocabulary)
            lines.append(rnd.choice([" ", "\t", "  "]).join(words[: rnd.choice([12, 12, 11, 5, 4, 1])]))
        rows.append((i, "\n".join(lines)))
    return [*rows, (None, "a b"), (1000, None), (1001, ""), (7, rows[7][1]), (1002, "\n\n \n")]


@pytest.mark.parametrize(("least", "rounds"), [(1, False), (5, False), (1, True)])
def test_lines_against_brute_force(spark, monkeypatch, least, rounds):
    if rounds:  # so few proposals at a time that some lines need several rounds
        for name, value in (("PROPOSED", 1), ("GROWTH", 1), ("HEAD", 2), ("HELD", 1), ("PIECE", 200), ("SURE", -1.0)):
            monkeypatch.setattr(line_dedup, name, value)
    rows = made_up(docs=60 if rounds else 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in repeated_lines(docs, min_words=least).collect()}
    assert got == brute(rows, least)


def test_documents_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert {tuple(r) for r in repeated_lines(docs).collect()} == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_removing_keeps_rows_and_columns(spark):
    rows = [(1, "a b c d e\nx", 9, "s"), (2, "y\na b c d e f", 9, "s"), (3, "a b c d e", 9, "s"), (4, None, None, None), (None, "a b c d e", 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, line string")
    got = {r.doc_id: (r.text, r.n_chars) for r in remove_lines(docs).collect()}
    assert got == {1: ("a b c d e\nx", 11), 2: ("y", 1), 3: ("", 0), 4: (None, None), None: ("a b c d e", 9)}
    assert remove_lines(docs).columns == docs.columns
    assert remove_lines(docs.where("false")).collect() == []
    assert line_dedup.SIMILARITY == Fraction(4, 5)


def licenses_of(scanner, text):
    shingles = shingles_of(words_of((text or "").encode()))
    out = set()
    for w in scanner.wanted:
        starts = range(max(1, len(shingles) - w.window + 1))
        if any(len(set(shingles[a : a + w.window]) & w.shingles) >= 0.8 * len(w.shingles) for a in starts):
            out.add(w.license)
    return out


def test_licenses_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()[:400] + [(9001, TEMPLATES[4].text.upper().replace("COPYRIGHT", "")), (9002, "so " * 300 + TEMPLATES[7].text), (9003, TEMPLATES[3].text.replace("work", "thing"))]
    scanner = Scanner(TEMPLATES)
    found = defaultdict(set)
    for r in find_licenses(spark.createDataFrame(rows, "doc_id long, text string"), TEMPLATES).collect():
        found[r.doc_id].add(r.license)
    assert found == {d: got for d, t in rows if (got := licenses_of(scanner, t))}
    assert {9001, 9002, 9003} <= set(found)


def test_license_spans_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(licenses, "PIECE", 400)
    text = "é x " * 500 + TEMPLATES[3].text + " und so weiter " * 200 + TEMPLATES[3].text
    spans = [(name, text[a:b]) for _, name, a, b, _ in scan_texts(Scanner(TEMPLATES), [None, "", text])]
    assert spans == [("GPL-3.0", TEMPLATES[3].text[:-1])] * 2
    docs = spark.createDataFrame([(None, TEMPLATES[0].text, 1), (1, None, 2)], "doc_id long, text string, start int")
    assert [(r.doc_id, r.license) for r in find_licenses(docs, TEMPLATES).collect()] == [(None, "MIT")]
    assert find_licenses(docs, []).collect() == find_licenses(docs.where("false"), TEMPLATES).collect() == []


def test_bands_reach_the_probability():
    for likeness in (0.42, 0.57, 0.75):
        assert (1 - likeness**licenses.ROWS) ** bands_for(likeness) <= licenses.MISSED


def test_places_that_fit_no_number(spark):
    """Negative and very large ids are ordered as ids, not as bits."""
    rows = [(-5, "one two three four"), (1 << 62, "one two three four\nfive six seven"), (7, "five six seven\none two three four"), (-(1 << 50), "other words here now")]
    gone = sorted(map(tuple, repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert gone == sorted(brute(rows, 1))
