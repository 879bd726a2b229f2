"""Clean rows that earlier versions of the stages lost."""

import random

import pytest

import corpus_pipeline
from larder.llm.langid import REST, fit_text_model, identify, keep_identified
from larder.llm.line_dedup import remove_lines
from larder.llm.simhash import keep_one

#: Two of them are named like columns that the stages add.
DOCS = "doc_id long, text string, lang string, source string, __hash string, key string"


def prose(rnd, letters, words):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 9))) for _ in range(words))


def test_lines_of_documents_that_share_an_id_are_their_own(spark):
    rows = [(1, "alpha beta gamma"), (2, "x y z\nalpha beta gamma"), (2, "clean line one\nclean other two"), (3, "clean other two\nlast"), (2, "clean line one\nclean other two"), (None, "alpha beta gamma"), (4, None)]
    kept = sorted(map(str, remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = [(1, "alpha beta gamma"), (2, "x y z"), (2, "clean line one\nclean other two"), (2, "clean line one\nclean other two"), (3, "last"), (None, "alpha beta gamma"), (4, None)]
    assert kept == sorted(f"Row(doc_id={d}, text={t!r})" for d, t in want)


def test_documents_that_share_an_id_are_judged_by_their_text(spark):
    rows = [(5, "a b c d e f", None, None, "x", "k"), (5, "other words entirely", None, None, "y", "k"), (6, "a b c d e f", None, None, "z", "k"), (5, "a b c d e f", None, None, "w", "k"), (None, "a b c d e f", "", "", "", "")]
    kept = keep_one(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "__hash", "key"]
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("5", "a b c d e f"), ("5", "other words entirely"), ("None", "a b c d e f")]
    assert keep_one(spark.createDataFrame([], DOCS)).collect() == []


@pytest.fixture(scope="module")
def rare(spark):
    """2,500 English documents, eight Finnish and a few of five other languages, each with letters of its own."""
    rnd = random.Random(4)
    rows = [(k, prose(rnd, "etaoinshrdlu", 40), "en", f"s{k % 3}", "", "") for k in range(2500)]
    rows += [(5000 + k, prose(rnd, "äöykkvaij", 40), "fi", "s0", "", "") for k in range(8)]
    rows += [(6000 + k, prose(rnd, "бгджзклм"[k % 5 :] , 40), lang, "s1", "", "") for k, lang in enumerate(("ru", "bg", "uk", "sr", "mk"))]
    rows += [(7000, prose(rnd, "etaoinshrdlu", 40), "fi", "s0", "", ""), (7001, prose(rnd, "äöykkvaij", 40), None, "s0", "", ""), (7002, "123 456", "en", "s0", "", "")]
    return spark.createDataFrame(rows, DOCS)


def test_rare_declared_languages_stay(spark, rare):
    kept = {r.doc_id for r in keep_identified(rare).collect()}
    assert set(range(5000, 5008)) <= kept and set(range(6000, 6005)) <= kept and len(kept & set(range(2500))) == 2500
    assert 7000 in kept and 7002 not in kept
    told = {r.doc_id: r.language for r in identify(rare, ["doc_id"], "text", "lang", None, "source").collect()}
    assert told[5000] == "fi" and told[6003] == "sr"
    assert told[7000] == "en"  # declared otherwise, but written so
    assert told[7001] is None  # nothing says which of the rare languages it is
    assert fit_text_model(rare.withColumnRenamed("lang", "declared"), "text", "declared").languages == [REST, "en"]


def test_the_stage_judges_as_the_operator_does(spark, rare):
    accepted = identify(rare, ["doc_id", "text"], "text", "lang", None, "source").where("accepted").select("doc_id", "text")
    assert sorted(map(str, keep_identified(rare).select("doc_id", "text").collect())) == sorted(map(str, accepted.collect()))


def test_stage_plans_move_no_text(spark, rare):
    plan = keep_identified(rare)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_very_long_texts_pass_the_stages(spark):
    rnd = random.Random(1)
    words = [prose(rnd, "etaoinshrdlu", 1) for _ in range(3000)]
    long_text = "\n".join(" ".join(rnd.choice(words) for _ in range(12)) for _ in range(40_000))
    assert len(long_text) > 2_000_000
    docs = spark.createDataFrame([(1, long_text, "en", "s"), (2, long_text + "\nanother line of it", "en", "s"), (3, "short words here", "en", "s")], "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.identify_language(spark, docs, ""), "")
    assert {r.doc_id for r in kept.collect()} == {1, 3}
    lines = {r.doc_id: r.text for r in corpus_pipeline.deduplicate_lines(spark, docs, "").collect()}
    assert lines[2] == "another line of it"
