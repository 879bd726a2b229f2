"""Stages and queries on small tables; the operators' own tests hold them against brute force."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from larder.llm.bpe import Vocabulary, public_vocabulary
from test_llm_lines_and_licenses import brute
from test_llm_simhash import fingerprint, groups

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """What each stage was given, and what the last one returned."""
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], FOLDER)))
    return out


def test_language_stage(tables):
    given, kept = tables[:2]
    assert kept.columns == given.columns
    assert sorted(kept.collect()) == sorted(given.collect())  # all of these are in a known language


def test_line_stage(tables):
    given, kept = ({r.doc_id: r.text for r in t.collect()} for t in tables[1:3])
    gone = brute(given.items(), corpus_pipeline.MIN_WORDS)
    assert kept == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in given.items()}
    assert tables[2].columns == tables[1].columns


def test_near_copy_stage(tables):
    given, kept = ({r.doc_id: r.text for r in t.collect()} for t in tables[2:4])
    roots = groups({d: fingerprint(t) for d, t in given.items()})
    assert kept == {d: t for d, t in given.items() if roots[d] == d}


def test_mixing_stage(tables):
    given, dealt = (Counter(r.doc_id for r in t.collect()) for t in tables[3:5])
    assert set(given) == set(dealt)  # nothing is thinned out
    assert max(dealt.values()) <= corpus_pipeline.MIX.repeats
    assert tables[4].columns == tables[3].columns


def test_encoding_stage(tables):
    own = Vocabulary(public_vocabulary())
    want = Counter()
    for r in tables[4].collect():
        ids = own.tokenizer.encode(r.text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want[r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, tables[5].collect())) == want


def test_pipeline_on_odd_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __text string"
    rows = [(None, None, None, None, None, "x"), (1, "the cat and the dog", "en", None, 19, "y"), (1, "the cat and the dog", "en", None, 19, "y"), (2, "", "en", "s", 0, None), (3, "word " * 30000, None, "s", 150000, "z")]
    for docs in (spark.createDataFrame(rows, schema).drop("__text"), spark.createDataFrame([], schema).drop("__text")):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialize(stage(spark, docs, FOLDER))
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_short_and_unspaced_lines_that_repeat_go(spark):
    rows = [(1, "Home\n\u3053\u306e\u6587\u7ae0\u306f\u4f55\u5ea6\u3082\u7e70\u308a\u8fd4\u3059\nfirst words of this document"), (2, "Home\n\u3053\u306e\u6587\u7ae0\u306f\u4f55\u5ea6\u3082\u7e70\u308a\u8fd4\u3059\nAll rights reserved."), (3, "All rights reserved.\nsomething else entirely here")]
    kept = {r.doc_id: r.text for r in corpus_pipeline.deduplicate_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), FOLDER).collect()}
    assert kept == {1: rows[0][1], 2: "All rights reserved.", 3: "something else entirely here"}
