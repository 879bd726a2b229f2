"""Operators against brute force, with one key that holds most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from larder.functions import geo, numeric
from larder.functions import text as X
from larder.operators import aggregates as A
from larder.operators import joins as J
from larder.operators import ordered as O
from larder.operators import pricing as P
from larder.operators import quality as Q
from larder.operators import sets as S
from larder.operators.units import convert_units
from larder.runtime import Scratch, shared_folder


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows of key 'hot', a few of others and of NULL, with ties and negative numbers."""
    rng = random.Random(7)
    keys = ["hot"] * 2000 + ["a", "a", "b", None, None, None] * 5
    rows = [(i, k, round(rng.gauss(0, 50), 1), rng.choice([None, 1.0, 2.5])) for i, k in enumerate(keys)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id long, key string, v double, level double").repartition(5)


def by_key(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    return groups


def test_lookup_and_salted_join_by_shuffle(skewed, spark):
    rows, df = skewed
    dim = spark.createDataFrame([("hot", 1), ("a", 2), (None, 3), ("c", 4)], "name string, n int")
    got = {r.id: r.n for r in J.lookup(df, dim, "key", "name", "id").collect()}
    assert got == {r[0]: {"hot": 1, "a": 2}.get(r[1]) for r in rows}
    joined = J.salted_join(df, dim.withColumnRenamed("name", "key"), "key", "id").collect()
    assert {r.id: r.n for r in joined} == {r[0]: {"hot": 1, "a": 2}[r[1]] for r in rows if r[1] in ("hot", "a")}
    assert len(joined) == len([r for r in rows if r[1] in ("hot", "a")])


def test_exact_median(skewed):
    rows, df = skewed
    got = {r.key: (r.median, r["count"]) for r in A.exact_median(df, ["key"], "v").collect()}
    for key, group in by_key(rows).items():
        values = [r[2] for r in group]
        assert got[key] == (pytest.approx(statistics.median(values), rel=1e-15), len(values))


def test_exact_median_orders_few_values(spark):
    """Of 40,000 different values of one key only the few near the middle are ordered by one task."""
    assert (A.BRACKET[1] - A.BRACKET[0] + 2 / A.ACCURACY) * 40_000 <= 33
    df = spark.range(40_000).select(F.lit("k").alias("key"), ((F.col("id") * 7919) % 40_000).cast("double").alias("v"))
    assert A.exact_median(df, ["key"], "v").first()["median"] == 19_999.5


def test_running_segments(skewed):
    rows, df = skewed
    got = {r.id: (r.start_value, r.end_value) for r in O.running_segments(df, ["key"], [F.desc("id")], "level", 7).collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        total = 0.0
        for row in sorted(group, key=lambda r: -r[0]):
            assert got[row[0]] == (total, total + (row[3] or 0.0))
            total += row[3] or 0.0


def test_slices_spread_a_hot_key(skewed):
    _, df = skewed
    sizes = O.sliced(df, ["key"], [F.asc("id")], 8).where("key = 'hot'").groupBy(O.SLICE).count().collect()
    assert len(sizes) >= 6 and max(r["count"] for r in sizes) < 600


def test_fill_down(skewed):
    rows, df = skewed
    got = {r.id: r.last for r in O.fill_down(df, ["key"], ["id"], "level", "last", 7).collect()}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        latest = None
        for row in sorted(group):
            latest = row[3] if row[3] is not None else latest
            assert got[row[0]] == latest


def test_numbered(skewed):
    rows, df = skewed
    got = {r.id: r.row_num for r in O.numbered(df.drop("level"), [F.desc("v"), F.asc("id")], slices=6).collect()}
    for number, row in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1):
        assert got[row[0]] == number


def test_best_per_group(skewed):
    rows, df = skewed
    got = {r.key: r.id for r in O.best_per_group(df, ["key"], ["v", "id"]).collect()}
    assert got == {k: min(g, key=lambda r: (r[2], r[0]))[0] for k, g in by_key(rows).items()}


def test_pivot_keeps_keys_and_order_of_columns(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "g"), (1, "b", 2.0, "mg"), (None, "a", 3.0, "g"), (2, "z", 4.0, "g")], "k int, n string, v double, u string")
    wide = A.pivot_long(df, ["k"], "n", ["b", "a"], {"value": "v", "unit": "u"})
    assert wide.columns == ["k", "b_value", "b_unit", "a_value", "a_unit"]
    assert {r.k: (r.b_value, r.a_value, r.a_unit) for r in wide.collect()} == {
        1: (2.0, 1.0, "g"), None: (None, 3.0, "g"), 2: (None, None, None)
    }
    assert A.strip_suffix(wide).columns == ["k", "b", "b_unit", "a", "a_unit"]


def test_cheapest_ignores_missing_prices_and_breaks_ties(spark):
    df = spark.createDataFrame([("c", 1, None, 5), ("c", 1, 2.0, 9), ("c", 1, 2.0, 7), ("c", 2, 3.0, 1)], "cat string, loc int, price double, id int")
    assert [(r.loc, r.id, r.price) for r in P.cheapest(df, ["cat", "loc"], "price", "id").orderBy("loc").collect()] == [(1, 7, 2.0), (2, 1, 3.0)]
    matrix = P.category_location_matrix(df, "cat", "loc", "price", "id", [2, 3]).first()
    assert matrix["2"].asDict() == {"id": 1, "price": 3.0} and matrix["3"] is None


def test_unit_price_in_32_bit(spark):
    df = spark.createDataFrame([(2.05, 1000.0, 1.0), (1.0, 0.0, 1.0), (0.0, 0.0, 1.0)], "price float, quantity float, rate double")
    got = [r[0] for r in df.select(P.unit_price(df, "price", "quantity", "rate")).collect()]
    assert got[0] == 0.20499999821186066 and got[1] == float("inf") and got[2] != got[2]
    wide = df.withColumn("price", F.col("price").cast("double"))
    assert wide.select(P.unit_price(wide, "price", "quantity", "rate")).first()[0] == pytest.approx(0.205, abs=1e-7)


def test_sets(spark):
    a, b, c = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 2, 3, 3], [3, 4], [4, 5, None]))
    assert sorted(r.k for r in S.union_codes("k", (a, "k"), (b, "k")).collect()) == [1, 2, 3, 4]
    assert sorted(map(tuple, S.key_differences(a, b, "k", ("a", "b")).collect())) == [(1, "a"), (2, "a"), (4, "b")]
    assert not S.same_keys(a, b, "k").first().same and S.same_keys(a, a, "k").first().same
    assert sorted(r.k for r in S.only_in_first(c, [b], "k").where("k IS NOT NULL").collect()) == [5]
    regions = {tuple(r)[:3]: r["keys"] for r in A.venn_regions({"a": a, "b": b, "c": c}, "k").collect()}
    assert regions == {(1, 0, 0): 2, (1, 1, 0): 1, (0, 1, 1): 1, (0, 0, 1): 1}


def test_rules(spark):
    df = spark.createDataFrame([(1, "g", 5, "x", "y"), (2, None, -1, "x", None), (3, "lb", 7, None, None)], "id int, unit string, n int, p string, q string")
    known = spark.createDataFrame([(5,), (5,), (-1,)], "n int")
    rules = [Q.Rule("unit", Q.one_of("unit", ["g"])), Q.Rule("positive", F.col("n") >= 0), Q.Rule("pair", Q.all_or_none("p", "q"))]
    got = Q.check_rules(df, rules, [Q.Reference("known", "n", known, "n")])
    assert sorted((r.id, r.rule) for r in got.collect()) == [(2, "pair"), (2, "positive"), (2, "unit"), (3, "known"), (3, "unit")]


def test_units(spark):
    table = spark.createDataFrame([("g", "g", 1.0), ("mg", "g", 0.001), ("kJ", "kcal", 0.239)], "from_unit string, to_unit string, conversion_factor double")
    df = spark.createDataFrame([(2.0, "g", "mg"), (1.0, "kJ", "g"), (3.0, "IU", "IU"), (3.0, "IU", "g"), (1.0, None, "g")], "v double, u string, w string")
    got = convert_units(df, "v", "u", "w", table, "c")
    assert {(r.u, r.w): r.c for r in got.collect()} == {("g", "mg"): 2000.0, ("kJ", "g"): None, ("IU", "IU"): 3.0, ("IU", "g"): None, (None, "g"): None}


def test_brush(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 50.0), (3, -170.0, 80.0)], "id int, lon double, lat double")
    x, y = geo.mercator_x(F.col("lon")), geo.mercator_y(F.col("lat"))
    assert places.select(x, y).first()[:] == (0.0, pytest.approx(0.0, abs=1e-12))
    chosen = P.brush(places, spark.createDataFrame([(3,)], "id int"), x, y, (-0.1, -0.5, 0.1, 0.1), "select")
    assert sorted(r.id for r in chosen.collect()) == [1, 2, 3]
    left = P.brush(places, chosen, x, y, (0.01, -0.5, 0.1, 0.1), "deselect")
    assert sorted(r.id for r in left.collect()) == [1, 3]
    with pytest.raises(ValueError):
        P.brush(places, chosen, x, y, (0, 0, 1, 1), "toggle")


def test_text(spark):
    df = spark.createDataFrame([("traces", "A\u00ad11-14", "Fibres or fiber (g/100g)"), ("< 1", "≤6 mo", "Energy, total (kJ/100g)"), ("-", "7-11", "Code")], "a string, b string, c string")
    got = df.select(X.measured(F.col("a")), X.plain_age(F.col("b")), X.header_name_and_unit(F.col("c"))).collect()
    assert [tuple(r)[:2] for r in got] == [(0.0, "A11-14"), (None, "<=6 mo"), (None, "7-11")]
    assert [tuple(r[2]) if r[2] else None for r in got] == [("Fibres", "g"), ("Energy, total", "kj"), None]
    assert df.select(X.without_hard_spaces(F.lit("AI\u00a0 in"))).first()[0] == "AI in"


def test_numeric_edges(spark):
    df = spark.createDataFrame([(float("nan"),), (1e300,), (None,), (-2.5,)], "x double")
    got = df.select(numeric.toward_zero(F.col("x")), numeric.is_finite(F.col("x")), numeric.gamma(F.col("x"))).collect()
    assert got[1][0] == 1e300 and got[3][0] == -2.0 and [r[1] for r in got] == [False, True, None, True]
    assert got[1][2] == float("inf") and got[2][2] is None


def test_scratch_tables_are_deleted(spark):
    from pathlib import Path

    folder = Path(shared_folder(spark))
    before = set(folder.iterdir())
    scratch = Scratch(spark)
    kept, gone = scratch.table(spark.range(3)), scratch.table(spark.range(4))
    assert len(set(folder.iterdir()) - before) == 2
    scratch.close(kept)
    assert len(set(folder.iterdir()) - before) == 1
    assert kept.count() == 3
    scratch.drop(kept, gone)
    assert set(folder.iterdir()) == before


def test_gamma_is_accurate(spark):
    import math

    values = [0.5, 1.0, 1.5, 2.0, 3.7, 5.0, 23.0, 24.0, 100.5, 171.0, -0.5, -3.7, 1e-5]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", numeric.gamma(F.col("x")), numeric.lgamma(F.col("x"))).collect()
    for x, g, lg in got:
        assert g == pytest.approx(math.gamma(x), rel=2e-13)
        assert lg == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-13)
    edge = spark.createDataFrame([(v,) for v in (0.0, -1.0, 172.0, float("inf"))], "x double").select(numeric.gamma(F.col("x")), numeric.lgamma(F.col("x"))).collect()
    assert [r[0] for r in edge] == [math.inf, None, math.inf, math.inf]  # no value is NULL here
    assert [math.isinf(r[1]) for r in edge] == [True, True, False, True]


def test_shared_folder_is_one_per_session(spark):
    assert shared_folder(spark) == shared_folder(spark)
