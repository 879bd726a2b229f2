import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.llm.mixing import Mix, entropy_reached, exponent, mix_sources, weights, word_count

TOTALS = {"a": 9000, "b": 900, "c": 90, "d": 0}


@pytest.fixture()
def totals(spark):
    return spark.createDataFrame(list(TOTALS.items()), "source_key string, size long")


def entropy(a):
    sizes = [n for n in TOTALS.values() if n]
    z = sum(n**a for n in sizes)
    return -sum(n**a / z * math.log(n**a / z) for n in sizes) / math.log(len(sizes))


def passes(a, budget):
    sizes = [n for n in TOTALS.values() if n]
    z = sum(n**a for n in sizes)
    tokens = budget * sum(sizes) if budget else max(sizes) * z / max(sizes) ** a
    return max(n**a / z * tokens / n for n in sizes)


def bisect(good):
    """Largest exponent for which good holds, as it does up to some point."""
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if good(middle) else (low, middle)
    return low


def test_entropy_target(totals):
    assert exponent(totals, Mix(entropy=0.9)) == pytest.approx(bisect(lambda a: entropy(a) >= 0.9), abs=1e-6)
    assert exponent(totals, Mix()) == 1.0
    assert exponent(totals, Mix(entropy=0.0)) == 1.0


@pytest.mark.parametrize("budget", [1.0, None])
def test_repetition_limit(totals, budget):
    want = bisect(lambda a: passes(a, budget) > 3)
    assert exponent(totals, Mix(repeats=3.0, budget=budget)) == pytest.approx(want, abs=1e-6)


def test_weights_sum_to_one(totals):
    rows = {r.source_key: r for r in weights(totals, Mix(entropy=0.9, budget=2.0)).collect()}
    assert sum(r.weight for r in rows.values()) == pytest.approx(1)
    assert sum(r.passes * r.size for r in rows.values()) == pytest.approx(2 * sum(TOTALS.values()), rel=1e-6)
    assert (rows["d"].weight, rows["d"].passes) == (0, 1)


def test_passes_are_realised(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"), F.repeat(F.lit("w "), 7).alias("text"), F.lit(1).alias("epoch")
    )
    dealt = mix_sources(docs, Mix(entropy=1.0, budget=1.0)).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("epoch").alias("e"))
    rows = {r.source: r for r in dealt.groupBy("source").agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"), F.min(F.col("n") == F.col("e")).alias("apart")).collect()}
    assert rows["small"].n == pytest.approx(3000, abs=2)  # half of the budget each: five passes over 600
    assert (rows["small"].least, rows["small"].apart) == (5, True)
    assert rows["large"].n == pytest.approx(3000, abs=2)
    assert rows["large"].most == 1


def test_nulls_empty_texts_and_repeats(spark):
    rows = [(None, None, None), (1, "a b", None), (1, "a b", None), (2, "", "s"), (3, "c", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    dealt = mix_sources(docs, Mix()).select("doc_id", "text", "source").collect()
    assert sorted(map(str, dealt)) == sorted(map(str, docs.collect()))
    assert mix_sources(docs.where("false"), Mix(repeats=2.0)).collect() == []


def test_words(spark):
    texts = [None, "", " \t\n", "a", " a  b\x0bc\r\n", "é\u00a0x y"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(word_count(F.col("t"))).collect()]
    assert got == [len((t or "").encode().split()) for t in texts]


@pytest.mark.parametrize("budget", [1.0, 1.4, 2.0, None])
def test_a_tiny_source_does_not_stop_the_mixing(spark, budget):
    """Its passes are cut off; the others are mixed as the entropy asks, and take what it leaves of the budget."""
    sizes = {"huge": 1_000_000, "large": 100_000, "small": 30_000, "tiny": 10}
    totals = spark.createDataFrame(list(sizes.items()), "source_key string, size long")
    mix = Mix(entropy=0.8, repeats=3.0, budget=budget)
    alone = exponent(totals, Mix(entropy=0.8, budget=budget))
    assert exponent(totals, mix) == alone < 0.7
    weighted = weights(totals, mix)
    rows = {r.source_key: r for r in weighted.collect()}
    whole, dealt = sum(sizes.values()), sum(r.size * r.passes for r in rows.values())
    assert max(r.passes for r in rows.values()) == 3.0 == rows["tiny"].passes
    if budget is not None:
        assert dealt == pytest.approx(budget * whole, rel=1e-6)
    free = {k: r.passes / (r.size ** (alone - 1)) for k, r in rows.items() if r.passes < 3.0}
    assert len(free) >= 1 and max(free.values()) == pytest.approx(min(free.values()), rel=1e-6)  # in proportion to their weights
    shares = [r.size * r.passes / dealt for r in rows.values()]
    assert [r.share for r in rows.values()] == pytest.approx(shares)
    assert entropy_reached(weighted) == pytest.approx(-sum(s * math.log(s) for s in shares) / math.log(4))


def test_a_budget_beyond_the_bound_deals_every_source_that_often(totals):
    rows = weights(totals, Mix(entropy=0.9, repeats=2.0, budget=5.0)).collect()
    assert {r.source_key: r.passes for r in rows} == {"a": 2.0, "b": 2.0, "c": 2.0, "d": 1.0}


def test_dealt_rows_equal_brute_force(spark):
    """Whole permuted blocks up to the budget of a pass; of the block it ends in, documents up to the first that reaches it."""
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 10 = 0 THEN 'small' WHEN id % 97 = 1 THEN 'tiny' ELSE 'large' END AS source", "repeat('w ', 1 + CAST(id % 7 AS INT)) AS text"
    )
    mix = Mix(entropy=0.9, repeats=2.5, budget=0.8)
    got = sorted((r.doc_id, r.epoch, r.block, r.place) for r in mix_sources(docs, mix).collect())
    hashed = docs.withColumn("hash", F.xxhash64("doc_id", "text", F.lit(1)))
    blocked = hashed.withColumn("own", F.pmod("hash", F.lit(1024)))
    epochs = F.explode(F.array(*[F.lit(e) for e in range(3)]))
    drawn = blocked.withColumn("epoch", epochs).withColumn("draw", F.xxhash64("hash", "epoch")).withColumn("order", F.xxhash64("own", "epoch", F.lit(1)))
    rows = drawn.selectExpr("doc_id", "source", "own", "epoch", "draw", "order", "1 + doc_id % 7 AS size").collect()
    size, blocks = Counter(), {}
    for r in rows:
        if r.epoch == 0:
            size[r.source] += r.size
        blocks.setdefault((r.source, r.epoch), {}).setdefault((r.order, r.own), []).append(r)
    totals = spark.createDataFrame(list(size.items()), "source_key string, size long")
    passes = {r.source_key: r.passes for r in weights(totals, mix).collect()}
    want = []
    for (source, epoch), held in blocks.items():
        left = round((passes[source] - epoch) * size[source])
        whole = passes[source] >= epoch + 1
        for turn, (_, members) in enumerate(sorted(held.items())):
            for r in sorted(members, key=lambda r: (r.draw, r.size)) if whole or left > 0 else ():
                if whole or left > 0:
                    want.append((r.doc_id, epoch, turn, r.draw))
                left -= r.size
    assert got == sorted(want)
