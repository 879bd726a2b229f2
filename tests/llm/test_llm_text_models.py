import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import langid, quality
from larder.llm.langid import identify, keep_identified
from larder.llm.quality import isotonic, remainder, score_quality, statistics_of

FOLDER = "/root/testdata/sf0.01"


def trigrams(text):
    b = bytes([32, *(text or "").encode(), 32])
    fold = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in b]
    return [tuple(fold[i : i + 3]) for i in range(len(fold) - 2) if fold[i + 1] != 32]


def test_language_posteriors_against_brute_force(spark):
    rows = [(1, "the cat and the dog", "en", "s1"), (2, "that is the thing", "EN-us", "s1"), (3, "der hund und die katze", "de", "s2"), (4, "das ist nicht der", None, "s2"), (5, "", "de", None), (6, None, None, None), (7, "и это", "de", "s1"), (3, "der hund und die katze", "de", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(map(tuple, identify(docs, ["doc_id"], "text", "lang", None, "source").select("doc_id", "language", "confidence", "letters").collect()))
    names = ["de", "en"]
    short = [d[:2].lower() if d else None for *_, d, _ in rows]
    hashed = lambda g: int(langid._trigrams(np.array([*g], np.uint8))[0][0])
    counts = {n: Counter(hashed(g) for (_, t, _, _), d in zip(rows, short, strict=True) if d == n and t for g in trigrams(t)) for n in names}
    size = langid.FEATURES
    # Likelihoods are kept in 32 bits per trigram.
    tables = {n: {g: np.log((c[g] + 0.05) / (sum(c.values()) + 0.05 * size)) for g in range(size)} for n, c in counts.items()}
    text_only, likely = [], []
    for _, t, _, _ in rows:
        scores = np.array([langid.TEMPER * sum(float(np.float32(tables[n][hashed(g)])) for g in trigrams(t)) for n in names] + [-langid.TEMPER * len(trigrams(t)) * float(np.float32(np.log(size)))])
        likely.append(scores)
        text_only.append(np.exp(scores - max(scores)) / np.exp(scores - max(scores)).sum())
    mass = sum(text_only)
    corpus = (mass + 1) / (mass.sum() + 3)

    def shrunk(members, parent):
        own = sum(text_only[i] for i in members)
        return (own + langid.SHRINK * parent) / (own.sum() + langid.SHRINK)

    declared = {d: sum(text_only[i] for i in range(len(rows)) if short[i] == d) for d in set(short) - {None}}
    want = []
    for i, (doc, t, _, host) in enumerate(rows):
        same = [k for k in range(len(rows)) if host and rows[k][3] == host]
        prior = shrunk(same, shrunk(same, corpus)) if host else corpus  # a host without dots is its own domain
        total = likely[i] + np.log(prior)
        if short[i]:
            total = total + np.log((declared[short[i]] + 1) / (sum(declared.values()) + len(declared) + 1))
        n, best = len(trigrams(t)), int(total.argmax())
        want.append((doc, [*names, None][best] if n else None, 1 / np.exp(total - total.max()).sum(), n))
    for g, w in zip(got, sorted(want), strict=True):
        assert (g[0], g[1], g[3]) == (w[0], w[1], w[3])
        assert math.isclose(g[2], w[2], rel_tol=1e-4)


def test_language_stage_keeps_columns_and_clean_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("language", F.expr("if(doc_id >= 0, 'clash', null)")).limit(200)
    junk = spark.createDataFrame([(10**6, "1234 5678", "en", "src0", 9, "x"), (10**6 + 1, None, None, None, None, None)], docs.schema)
    kept = keep_identified(docs.union(junk))
    assert kept.columns == docs.columns
    assert kept.where("doc_id < 1000000").count() == docs.count()
    assert kept.where("doc_id >= 1000000").count() == 0
    assert keep_identified(docs.where("false")).collect() == []


def test_rare_languages_beside_a_hot_text_keep_their_documents(spark):
    rows = [(i, f"the cat and the dog number {i} sat there with that thing", "en", "s1") for i in range(4000)]
    rows += [(10_000 + i, "one text that a third of all rows repeats", "en", "s1") for i in range(2000)]
    rows += [(20_000 + i, f"kissa ja koira {i} istuivat yhdess\u00e4 p\u00f6yd\u00e4ll\u00e4", "fi", "s1") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.language for r in identify(docs, ["doc_id"], "text", "lang", None, "source", 50).where("accepted").collect()}
    assert got == {d: lang for d, _, lang, _ in rows}


def test_markup_and_address_decide_where_text_cannot(spark):
    rows = [(i, "the of and that", "en", "uk", "a.x.uk") for i in range(30)] + [(100 + i, "der die das und", "de", "at", "b.y.at") for i in range(30)]
    rows += [(500, "xq", None, "at", "b.y.at"), (501, "xq", None, "uk", "c.x.uk"), (502, "xq", "de", None, None)]
    pages = spark.createDataFrame(rows, "page_id int, text string, declared string, suffix string, host string")
    got = {r.page_id: r.language for r in identify(pages, ["page_id"], "text", "declared", "suffix", "host").where("page_id >= 500").collect()}
    assert got == {500: "de", 501: "en", 502: "de"}


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs, labels, learns=remainder() != 1).join(labels, "doc_id").where(remainder() == 1)
    row = scored.agg(F.count("*"), F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()
    assert row[0] > 1000
    assert row[1] >= 0.97


def test_quality_without_labels_text_or_ids(spark):
    docs = spark.createDataFrame([(None, None, 3), (1, "", 4), (2, "some words", 5), (2, "some words", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (77, 0)], "doc_id long, quality int")
    got = score_quality(docs, labels).collect()
    assert len(got) == 4
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert score_quality(docs.where("false"), labels).collect() == []
    assert len(statistics_of("a b")) == len(statistics_of("")) == len(quality.STATISTICS)


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(3)
    y, w = rng.random(40), rng.integers(1, 5, 40).astype(float)
    at, fit = isotonic(np.arange(40.0), y, w)
    # Minimax formula: the fit at i is max over a <= i of min over b >= i of the mean of a..b.
    mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])
    want = sorted({round(max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)), 9) for i in range(40)})
    assert [round(v, 9) for v in fit] == pytest.approx(want)
    assert (np.diff(at) > 0).all()
