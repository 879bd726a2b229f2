import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import forest, topk
from larder.llm.forest import nearest
from larder.llm.topk import top_inner_products
from larder.llm.vectors import usable

SCHEMA = "vec_id long, embedding array<float>, v string"


def odd_rows():
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)], "x") for i in range(300)]
    rows += [(1000 + i, rows[7][1], "copy") for i in range(40)]  # ties
    rows += [(2000, None, ""), (2050, [], ""), (None, [1.0] * 6, ""), (2100, [1.0, None], ""), (2150, [float("nan")] * 6, ""), (2200, [float("inf")], ""), (2250, [0.5, 0.5], "")]
    return rows + rows[:3]


def brute_top(rows, k):
    seen = {i: np.array([math.floor(256 * np.float32(x).astype(float)) for x in v] + [0] * (6 - len(v))) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q in seen:
        if q % 50 == 0:
            out[q] = sorted((-int(seen[q] @ x), i) for i, x in seen.items() if i != q)[:k]
    return out


@pytest.mark.parametrize("annulus", [16, 4096])
def test_top_k_equals_brute_force(spark, annulus):
    rows = odd_rows()
    given = usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
    whole = given.withColumn("v", F.transform("v", lambda x: F.floor(x * 256).cast("double")))
    got = top_inner_products(whole, whole.where("vec_id % 50 = 0"), 5, pivots=6, annulus=annulus)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert found == brute_top(rows, 5)


def test_fewer_candidates_than_k(spark):
    three = spark.createDataFrame([(0, [1.0, 2.0]), (50, [3.0, 4.0]), (51, [3.0, 4.0])], "vec_id long, v array<double>")
    got = [tuple(r) for r in top_inner_products(three, three.where("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [(0, 1, 50, 11), (0, 2, 51, 11)]
    assert top_inner_products(three.where("false"), three.where("false"), 5).collect() == []
    assert len(nearest(three, three, 10).collect()) == 6
    assert nearest(three.where("false"), three, 10).collect() == []


def test_isolated_query_keeps_looking_until_it_has_k(spark):
    """A pair of equal vectors of greatest norm is an annulus of its own: the first visit gives one result, not five."""
    rnd = random.Random(3)
    rows = [(i, [float(rnd.randrange(-9, 10)) for _ in range(4)]) for i in range(1, 400)] + [(0, [900.0, 900.0, 0.0, 0.0]), (1000, [900.0, 900.0, 0.0, 0.0])]
    given = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = top_inner_products(given, given.where("vec_id = 0"), 5, pivots=6, annulus=16).orderBy("rank").collect()
    own = np.array(rows[-1][1])
    assert [(-r.score, r.vec_id) for r in got] == sorted((-int(own @ np.array(v)), i) for i, v in rows if i)[:5]


def test_large_products_are_exact():
    q, x = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**22 + 1, 5.0]])
    assert topk.inner_products(q, x)[0, 0] == (2**40 + 1) * (2**22 + 1) + 15


def test_small_blocks_are_searched_whole(spark):
    rows = odd_rows()
    given = usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").where(F.exists("v", lambda x: x != 0))
    seen = {r.vec_id: np.array(r.v + [0.0] * (6 - len(r.v))) for r in given.collect()}
    got = nearest(given, given.where("vec_id % 100 = 0"), 10, block=100).orderBy("query_id", "rank").collect()
    for q in {r.query_id for r in got}:
        want = sorted((float(np.sqrt(((x - seen[q]) ** 2).sum())), i) for i, x in seen.items() if i != q)[:10]
        assert [(r.score, r.vec_id) for r in got if r.query_id == q] == want


def test_recall_through_the_forest(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAST", 64)  # no block is small enough to be searched whole
    given = usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding")
    ids, x = zip(*given.orderBy("vec_id").toPandas().itertuples(index=False), strict=True)
    x = np.array([list(v) for v in x])
    got = nearest(given, given.where("vec_id % 100 = 0"), 10).toPandas()
    hits = 0
    for q, found in got.groupby("query_id"):
        away = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        away[ids.index(q)] = np.inf
        hits += len(set(found.vec_id) & {ids[i] for i in np.lexsort((ids, away))[:10]})
    assert hits / len(got) >= 0.9
