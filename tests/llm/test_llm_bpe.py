import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import bpe
from larder.llm.bpe import LEAF, Leaf, Vocabulary, decode, digests, encode, join_tree, public_vocabulary

TABLE = "/root/testdata/sf0.01/documents.parquet"
PIECES = [
    "a", "the", "  ", "\n", "\t", "\u00a0", "é", "ß", "'s", "'re", "12", "!!", "ab", "xyzzy", "ing", "\u3000", "漢字", "🙂", "\x1c", "\x85",
    "ℵ", "\U00010940", "\u0c5c", "'", "r", "e",
]


@pytest.fixture(scope="module")
def own():
    return Vocabulary(public_vocabulary())


def library(own, text):
    return own.tokenizer.encode(text, add_special_tokens=False).ids


def ids(blob):
    return np.frombuffer(blob, "<u4").tolist()


def test_texts_encode_like_the_library(own):
    rnd = random.Random(1)
    for _ in range(600):
        text = "".join(rnd.choice([*PIECES, "<|endoftext|>"]) for _ in range(rnd.randint(0, 60)))
        assert ids(own.encode(text)) == library(own, text)
        assert own.decode(own.encode(text)) == own.tokenizer.decode(library(own, text), skip_special_tokens=False) == text


def test_long_words_by_halves(own, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_WORD", 16)
    rnd = random.Random(2)
    for n in range(400):
        own.known.clear()
        text = "".join(rnd.choice("abtheingrson" if n % 2 else "aé") for _ in range(rnd.randint(10, 400)))
        assert ids(own.encode(text)) == library(own, text)


def test_leaves_cut_anywhere_join_exactly(own):
    rnd = random.Random(3)
    for n in range(500):
        size = rnd.choice([3, 9, 17, 40])
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 200)))
        if n % 5 == 0:
            text = " " * rnd.randint(0, 150) + text + "a" * rnd.randint(0, 200) + " " * 99 + "b"
        tree = join_tree(own, [Leaf.of(text[a : a + size], *own.leaf(text[a : a + size])) for a in range(0, len(text), size)])
        assert tree.text == text
        assert ids(b"".join(tree.ids)) == library(own, text)


def test_rows_nulls_and_long_texts(spark, own):
    long = "unsplit" * 300 + " and <|endoftext|> more words " * 40
    rows = [(1, None, 1), (None, "", 2), (1, "<|endoftext|>" * 3 + "ab" * 30, 3), (1, long, 4), (1, long, 4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids int")
    path = public_vocabulary()
    got = decode(encode(docs, path, leaf=50), path).select("doc_id", "text", "ids", "decoded").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(a), str(b)) for a, b, _ in rows)
    for r in got:
        assert ids(r.ids) == library(own, r.text or "")
        assert r.decoded == (r.text or "")
    assert encode(docs.where("false"), path).collect() == []


def test_digest_columns(spark):
    docs = spark.createDataFrame([(5, "a b", "x")], "doc_id long, text string, n_tokens string")
    row = digests(docs, public_vocabulary()).first()
    assert (row.doc_id, row.n_tokens) == (5, 2)
    assert row.decoded_sha256 == docs.select(F.sha2("text", 256)).first()[0]


@pytest.mark.skipif(not Path(TABLE).exists(), reason="test tables are not here")
def test_given_texts_go_through_halves_and_leaves(spark):
    """The test table's words and texts are long enough for both trees, and give what the library gives."""
    own = Vocabulary(public_vocabulary())
    texts = [r.text for r in spark.read.parquet(TABLE).select("text").collect()]
    long_ones = [t for t in texts if t and len(t) > LEAF]
    assert long_ones
    for text in texts[:300]:
        own.encode(text or "")
    assert own.joints["words"] > 100 and own.joints["leaves"] == 0
    for text in long_ones[:20]:
        leaves = [Leaf.of(text[a : a + LEAF], *own.leaf(text[a : a + LEAF])) for a in range(0, len(text), LEAF)]
        joined = join_tree(own, leaves)
        assert np.frombuffer(b"".join(joined.ids), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own.joints["leaves"] >= len(long_ones[:20])


def test_digests_hand_over_few_rows_at_once(spark, monkeypatch):
    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", [], bpe.materialize
    monkeypatch.setattr(bpe, "materialize", lambda df: (seen.append(int(spark.conf.get(name))), write(df))[1])
    before = spark.conf.get(name)
    docs = spark.range(1200).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    assert digests(docs, public_vocabulary()).count() == 1200
    assert seen == [bpe.ROWS] and spark.conf.get(name) == before


def test_decoding_needs_the_file_alone():
    """Bytes of every id are those the tokenizer has, special tokens included, but no tokenizer is built."""
    path = public_vocabulary()
    assert bpe.spellings(path) == Vocabulary(path).bytes_of
