"""BPE encoding and decoding, with long texts put together from separately encoded parts.

A text is split into words by the vocabulary's own rule, and each word is encoded once per task and
remembered. Two things can be long, and both are encoded by tree concatenation: halves are encoded
apart and joined, re-encoding a window around the joint that grows until both sides agree.

Long words (`encode_word`). Two token sequences are one valid encoding exactly when every adjacent
pair of tokens encodes to itself. A window that begins with the left side's token there and ends with
the right side's therefore proves the joined sequence.

Long texts (`Leaf`, `join_leaves`). Leaves of a document are encoded by different tasks. Splitting is
deterministic from any word boundary rightwards, so a window that starts at a boundary of the left
leaf and meets a boundary of the right one, both clear of the cut, proves all words beyond.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.batches import rows_at_once
from larder.runtime import materialize

#: Fixed value: the word pattern of byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside these ranges may be classed by the tokenizer's Unicode version otherwise than by
#: the regex module's; words of texts that have one are cut by the tokenizer itself.
UNSURE = re.compile("[^\x00-՗ -₎₠-ꟍ가-￿\U0001f000-\U0001faff]")
LONG_WORD = 16  # bytes; longer words are encoded in halves
LEAF = 1 << 15  # characters; longer texts are encoded in leaves
REPEATING = 256  # characters; longer words are not remembered
MARGIN = 4  # characters next to a cut, whose splitting may depend on what lies beyond it
ROWS = 500  # rows that a worker of digests is handed at once
REMEMBERED = 200_000  # words a task remembers before it starts anew


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def bytes_by_id(tokens: dict[str, int]) -> list[bytes]:
    back = {c: b for b, c in enumerate(byte_characters())}
    out = [b""] * (max(tokens.values(), default=-1) + 1)
    for token, i in tokens.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def spellings(path: str) -> list[bytes]:
    """Each id's bytes, special tokens included, from a vocabulary's file alone: decoding needs no encoder, which is four times as large."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    return bytes_by_id(given["model"]["vocab"] | {t["content"]: t["id"] for t in given.get("added_tokens") or []})


class Vocabulary:
    """A byte-level BPE file of the tokenizers library; encodes and decodes whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.to_characters = dict(enumerate(byte_characters()))
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = bytes_by_id(self.tokenizer.get_vocab(with_added_tokens=True))
        self.find_words = regex.compile(WORDS).findall
        self.known: dict[str, bytes] = {}
        self.joints = {"words": 0, "leaves": 0}  # how often two encoded parts were joined

    def words(self, text: str) -> list[str]:
        if UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.find_words(text)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one short run of bytes."""
        return [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.to_characters))]

    def encode_bytes(self, raw: bytes) -> list[int]:
        """Ids of a word of any length, by halves."""
        if len(raw) <= LONG_WORD:
            return self.merge(raw)
        half = len(raw) // 2
        return self.join_runs(self.encode_bytes(raw[:half]), self.encode_bytes(raw[half:]))

    def join_runs(self, left: list[int], right: list[int]) -> list[int]:
        """One encoding of what two encodings spell together."""
        width = 4
        self.joints["words"] += 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = b"".join(self.bytes_of[i] for i in left[a:] + right[:b])
            # A window as long as both sides needs no proof; a long one is itself made of halves' halves.
            got = self.merge(window)
            first = a == 0 or got[0] == left[a]
            last = b == len(right) or got[-1] == right[b - 1]
            if first and last:
                return left[:a] + got + right[b:]
            width *= 2

    def encode_word(self, word: str) -> bytes:
        ids = np.array(self.encode_bytes(word.encode()), "<u4").tobytes()
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(word) <= REPEATING:
            self.known[word] = ids
        return ids

    def encode_words(self, words: list[str]) -> list[bytes]:
        known = self.known.get
        return [known(w) or self.encode_word(w) for w in words]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = self.specials.split(text) if self.specials else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out += self.encode_words(self.words(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return spelled(self.bytes_of, ids)

    def leaf(self, text: str) -> tuple[bytes, bytes, bytes]:
        """Ids, and for each word its length in characters and its number of ids; no special tokens inside."""
        words = self.words(text)
        ids = self.encode_words(words)
        return b"".join(ids), np.fromiter(map(len, words), "<u4", len(words)).tobytes(), (np.fromiter(map(len, ids), "<u4", len(ids)) // 4).astype("<u4").tobytes()

    def join_leaves(self, left: Leaf, right: Leaf) -> Leaf:
        if not left.text or not right.text:
            return left if left.text else right
        self.joints["leaves"] += 1
        reach = 64
        while True:
            start = left.boundary_before(len(left.text) - max(reach, MARGIN))
            whole = reach >= len(right.text)
            stop = len(right.text) if whole else reach
            window = left.text[start:] + right.text[:stop]
            words = self.words(window)
            cut, at = len(left.text) - start, 0
            taken = []
            met = None
            for word in words:
                if at >= cut and at + MARGIN < len(window) and (k := right.word_at(at - cut)) is not None:
                    met = k
                    break
                taken.append(word)
                at += len(word)
            if met is not None or whole:
                ids = self.encode_words(taken)
                return left.upto(start) + Leaf("".join(taken), [len(w) for w in taken], ids) + (right.beyond(met) if met is not None else Leaf("", [], []))
            reach *= 2


def spelled(bytes_of: list[bytes], ids: bytes) -> str:
    return b"".join([bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


class Leaf:
    """A text, its words' lengths and their encoded ids."""

    def __init__(self, text: str, lengths: list[int], ids: list[bytes]):
        self.text, self.lengths, self.ids = text, lengths, ids
        self.starts = [0, *accumulate(lengths)]

    @classmethod
    def of(cls, text: str, ids: bytes, lengths: bytes, counts: bytes) -> Leaf:
        ends = np.cumsum(np.frombuffer(counts, "<u4")) * 4
        return cls(text, np.frombuffer(lengths, "<u4").tolist(), [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)] if len(ends) else [])

    def boundary_before(self, at: int) -> int:
        """The last word start at or before a position."""
        return self.starts[max(0, bisect_left(self.starts, at + 1) - 1)] if at > 0 else 0

    def word_at(self, at: int) -> int | None:
        k = bisect_left(self.starts, at)
        return k if k < len(self.lengths) and self.starts[k] == at else None

    def upto(self, at: int) -> Leaf:
        k = bisect_left(self.starts, at)
        return Leaf(self.text[:at], self.lengths[:k], self.ids[:k])

    def beyond(self, word: int) -> Leaf:
        return Leaf(self.text[self.starts[word] :], self.lengths[word:], self.ids[word:])

    def __add__(self, other: Leaf) -> Leaf:
        return Leaf(self.text + other.text, self.lengths + other.lengths, self.ids + other.ids)


def join_tree(vocabulary: Vocabulary, leaves: list[Leaf]) -> Leaf:
    while len(leaves) > 1:
        pairs = [vocabulary.join_leaves(*leaves[k : k + 2]) for k in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[len(pairs) * 2 :]
    return leaves[0] if leaves else Leaf("", [], [])



def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", leaf: int = LEAF) -> DataFrame:
    """Adds `ids`: each whole text's token ids, little-endian unsigned 32-bit integers in one binary.

    vocabulary: path of a byte-level BPE file, readable on every executor. Special tokens written in a
    text become their ids, nothing else is added. A null text counts as empty and gets empty ids. Texts
    of more than `leaf` characters are cut, their leaves encoded by different tasks and joined per row.
    An input column named `ids` is replaced.
    """
    kept = [c for c in docs.columns if c != ids]
    rows = docs.select(*[docs[c] for c in kept]).withColumn("__text", F.coalesce(docs[text], F.lit("")))
    short = rows.where(F.length("__text") <= leaf)
    schema = short.drop("__text").withColumn(ids, F.lit(b"")).schema

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                encoded = pa.array([own.encode(t) for t in part.column(part.num_columns - 1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], encoded], [*part.schema.names[:-1], ids])

    done = short.mapInArrow(encode_rows, schema)
    return done.unionByName(_encode_long(rows.where(F.length("__text") > leaf), vocabulary, kept, ids, leaf))


def _encode_long(rows: DataFrame, vocabulary: str, kept: list[str], ids: str, leaf: int) -> DataFrame:
    """Rows with long texts: leaves are dealt out over tasks, and each row's leaves meet again once encoded.

    Special tokens cut a text first, so that no leaf boundary falls into one.
    """
    loaded: dict[str, Vocabulary] = {}  # a task loads the vocabulary once, for all its rows

    def known() -> Vocabulary:
        if vocabulary not in loaded:
            loaded[vocabulary] = Vocabulary(vocabulary)
        return loaded[vocabulary]

    whole = rows.select(F.monotonically_increasing_id().alias("row"), "__text", F.struct(*kept).alias("kept"))
    kept_type = whole.schema["kept"].dataType
    ddl = f"row long, part long, leaf long, piece string, kept {kept_type.simpleString()}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known()
        for batch in batches:
            for at in range(batch.num_rows):
                given = batch.slice(at, 1)
                text = given.column(1)[0].as_py()
                for k, part in enumerate(own.specials.split(text) if own.specials else [text]):
                    pieces = [part] if k % 2 else [part[a : a + leaf] for a in range(0, max(1, len(part)), leaf)]
                    for n, piece in enumerate(pieces):
                        # The row's other columns travel once, with its first leaf.
                        others = given.column(2) if k == n == 0 else pa.nulls(1, given.column(2).type)
                        yield pa.RecordBatch.from_arrays(
                            [given.column(0), pa.array([k], pa.int64()), pa.array([n], pa.int64()), pa.array([piece], pa.string()), others],
                            ["row", "part", "leaf", "piece", "kept"],
                        )

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known()
        for batch in batches:
            for k in range(batch.num_rows):
                given = batch.slice(k, 1)
                piece = given.column(3)[0].as_py()
                special = given.column(1)[0].as_py() % 2
                got = (np.array([own.special[piece]], "<u4").tobytes(), b"", b"") if special else own.leaf(piece)
                yield pa.RecordBatch.from_arrays(
                    [*given.columns, *(pa.array([x], pa.binary()) for x in got)], [*given.schema.names, "ids", "lengths", "counts"]
                )

    def put_together(row: pa.Table) -> pa.Table:
        own, ids_of = known(), []
        row = row.sort_by([("part", "ascending"), ("leaf", "ascending")])
        columns = [row.column(c).to_pylist() for c in ("part", "piece", "ids", "lengths", "counts")]
        for part, leaves in groupby(zip(*columns, strict=True), key=lambda x: x[0]):
            if part % 2:
                ids_of += [x[2] for x in leaves]
            else:
                ids_of += join_tree(own, [Leaf.of(*x[1:]) for x in leaves]).ids
        return pa.table({"kept": row.column("kept").slice(0, 1), "ids": pa.array([b"".join(ids_of)], pa.binary())})

    encoded = whole.mapInArrow(cut, ddl).repartition("row", "part", "leaf").mapInArrow(encode_leaves, f"{ddl}, ids binary, lengths binary, counts binary")
    joined = encoded.groupBy("row").applyInArrow(put_together, f"kept {kept_type.simpleString()}, ids binary")
    return joined.select(*[F.col("kept").getField(c).alias(c) for c in kept], F.col("ids").alias(ids))


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds `decoded`: the text that each row's ids spell, special tokens included; null ids count as none."""
    kept = [c for c in rows.columns if c != decoded]
    given = rows.select(*[rows[c] for c in kept], F.coalesce(rows[ids], F.lit(b"")).alias("__ids"))
    schema = given.drop("__ids").withColumn(decoded, F.lit("")).schema

    def decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = spellings(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts = pa.array([spelled(table, b) for b in part.column(part.num_columns - 1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], [*part.schema.names[:-1], decoded])

    return given.mapInArrow(decode_rows, schema)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of documents.

    The job runs here, few rows at a time: a task has texts, ids and decoded texts of a batch on both sides of two workers.
    """
    both = decode(encode(docs.select("doc_id", "text"), vocabulary).select("doc_id", "ids"), vocabulary)
    digested = both.select(
        "doc_id",
        F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )
    with rows_at_once(docs.sparkSession, ROWS):
        return materialize(digested)


def public_vocabulary() -> str:
    """The path of the vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_vocabulary())


QUERIES = {"op6_bpe": op6_bpe}
SQL: dict[str, str] = {}
