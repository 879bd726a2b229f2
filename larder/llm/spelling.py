"""Spelling variant grouping: words one edit apart, found by PartEnum signatures of their letter multisets.

A word's letters, the k-th occurrence of each counted apart, are a binary vector. One inserted or deleted
letter changes one of its bits, a replaced one two, so near words are at a Hamming distance of at most two.
The bits are dealt to PARTS parts by hash. Two bits touch at most two parts, so near words agree exactly in
all the others: a word signs each choice of PARTS - 2 parts with what it has there, words that share a
signature are joined on it, and the edit itself is verified on the words.

Every join has the vocabulary on both sides, and deals them by key. Left to Spark's estimate a side could be broadcast
through the driver: it sizes signatures as the words they are made of, and words as their compressed files.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.runtime import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[a-zÀ-ÿ]+"  # after A-Z is lower-cased
DISTANCE = 2  # bits that one edit changes, at most
PARTS = 8  # 28 signatures a word, each over six eighths of the bits
SLIPS = 97  # of so many hashes one slips
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
DEALT = "merge"  # the hint that keeps a join from broadcasting, whatever the estimate


def slipped(run: Column, doc_id: Column, every: int = SLIPS) -> Column:
    """The run, without one code point where `every` divides the checksum of document and run."""
    checksum = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(checksum, F.length(run).cast("long")).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(checksum, F.lit(every)) == 0, shorter).otherwise(run)


def vocabulary(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = SLIPS, length: int = LEAST_LENGTH, count: int = LEAST_COUNT
) -> DataFrame:
    """word and n of all words of all texts; tasks count their own words before any moves."""
    runs = docs.select(
        docs[doc_id].alias("doc_id"), F.explode(F.regexp_extract_all(F.translate(docs[text], UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run")
    )
    # A slip only shortens: shorter runs are no words anyway.
    words = runs.where(F.length("run") >= length).select(slipped(F.col("run"), F.col("doc_id"), every).alias("word")).where(F.length("word") >= length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def _held(part: int, parts: int):
    return lambda bit: F.pmod(F.shiftright(bit, 32), F.lit(parts)) == part


def signatures(words: DataFrame, parts: int = PARTS, distance: int = DISTANCE) -> DataFrame:
    """The columns of words with `signature`, one row for each choice of parts.

    A part holds the sum of its bits' hashes, which no order of letters changes.
    """
    letters = words.withColumn("__letters", F.array_sort(F.split("word", "")))
    # In order, a letter's first place is known: the distance to it tells its occurrences apart.
    bit = lambda letter, k: F.xxhash64(letter, k + 1 - F.array_position("__letters", letter).cast("int"))
    bits = letters.withColumn("__bits", F.transform("__letters", bit))
    total = F.lit(0).cast("decimal(38,0)")
    held = bits.withColumn("__parts", F.array(*[F.aggregate(F.filter("__bits", _held(p, parts)), total, lambda a, b: a + b) for p in range(parts)]))
    choices = F.array(*[F.array(*[F.lit(p) for p in choice]) for choice in combinations(range(parts), parts - distance)])
    chosen = held.withColumn("__choice", F.explode(choices))
    signature = F.xxhash64("__choice", F.transform("__choice", lambda p: F.col("__parts")[p]))
    return chosen.withColumn("signature", signature).drop("__letters", "__bits", "__parts", "__choice")


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """word and other, both ways, of all words that one edit of a code point turns into each other.

    words: one column, distinct. Both sides of the join are the same rows, dealt once by their signature.
    """
    signed = signatures(words.select("word"), parts)
    a, b = signed.alias("a"), signed.alias("b")
    met = a.join(b.hint(DEALT), F.col("a.signature") == F.col("b.signature")).where("a.word < b.word")
    pairs = met.select(F.col("a.word").alias("a"), F.col("b.word").alias("b")).where(F.levenshtein("a", "b", 1) == 1).distinct()
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other")))


def forms(counted: DataFrame, near: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form and form_n: the commonest near word (ties: the first in code-point order), if common enough."""
    others = counted.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = near.join(others.hint(DEALT), "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = counted.join(best.hint(DEALT), "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    return found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )


def roots(formed: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root of every word: forms are followed twice as far each round.

    Counts at least double from a word to its form, so no chain is longer than the logarithm of the largest count.
    """
    steps = formed.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further")).where("root <> further")
        after = scratch.table(steps.join(onward.hint(DEALT), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = not after.where("moved").isEmpty()
        steps = after.drop("moved")
        if not moved:
            return steps


def spelling_variants(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    every: int = SLIPS,
    length: int = LEAST_LENGTH,
    count: int = LEAST_COUNT,
    ratio: int = RATIO,
    parts: int = PARTS,
) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of at least `length` code points and `count` occurrences.

    Null and empty texts have no words; an empty table gives no rows. A null doc_id counts as empty text in the
    checksum. Repeated rows count as often as they are there. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    counted = scratch.table(vocabulary(docs, doc_id, text, every, length, count))
    formed = scratch.table(forms(counted, near_words(counted, parts), ratio))
    rooted = roots(formed, scratch)
    result = scratch.table(formed.join(rooted.hint(DEALT), "word"))
    scratch.close(result)
    return result


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {"op12_spelling": op12_spelling}
#: CRC-32 (reflected polynomial 0xEDB88320) bit by bit over a table of 256 entries; near words share a string with one code point deleted.
SQL = {
    "op12_spelling": """
WITH RECURSIVE table_of AS (
  SELECT list(list_reduce([b::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc
  FROM range(256) AS t(b)
), texts AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), runs AS (
  SELECT run, count(*) AS times, doc_id::VARCHAR || ':' || run AS tagged FROM texts GROUP BY run, doc_id
), bytes AS (
  SELECT run, times, list_transform(range(octet_length(encode(tagged))), lambda k: ('0x' || substring(hex(encode(tagged)), (2 * k + 1)::BIGINT, 2))::BIGINT) AS raw FROM runs
), summed AS (
  SELECT run, times, xor(list_reduce([4294967295::BIGINT] || raw, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, table_of
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, times FROM summed
), counted AS (
  SELECT word, sum(times)::BIGINT AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), cut AS (
  SELECT word, n, k, substring(word, 1, k) || substring(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)::BIGINT)) AS k FROM counted)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN counted w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN counted w ON c.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, min({'less': -other_n, 'other': encode(other)}) AS best FROM near GROUP BY word
), formed AS (
  SELECT counted.word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -best.best.less >= 2 * n THEN decode(best.best.other) END AS form, CASE WHEN -best.best.less >= 2 * n THEN -best.best.less END AS form_n
  FROM counted LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON s.next = f.word
)
SELECT formed.word, form, steps.at AS root, n, n_near, form_n::BIGINT AS form_n FROM formed JOIN steps ON steps.word = formed.word AND steps.next IS NULL
"""
}
