"""Optimal diets against corner enumeration, and the proof of optimality on skewed data."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.plans import diets as D
from larder.plans import reports as R
from larder.plans.simplex import solve, solve_from


def corners(cost, amounts, lower, upper):
    """Least cost over all corners of the feasible region, None if there is none."""
    m, n = amounts.shape
    planes = [(np.eye(n)[j], 0.0) for j in range(n)]
    planes += [(amounts[i], b) for i in range(m) for b in (lower[i], upper[i]) if np.isfinite(b)]
    best = None
    for chosen in itertools.combinations(planes, n):
        a = np.array([p[0] for p in chosen])
        if abs(np.linalg.det(a)) < 1e-9:
            continue
        x = np.linalg.solve(a, np.array([p[1] for p in chosen]))
        level = amounts @ x
        if (x >= -1e-7).all() and (level >= lower - 1e-6).all() and (level <= upper + 1e-6).all():
            best = min(cost @ x, np.inf if best is None else best)
    return best


numbers = st.integers(0, 9)


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_simplex_finds_the_best_corner(data):
    n, m = data.draw(st.integers(1, 4)), data.draw(st.integers(1, 3))
    amounts = np.array([[data.draw(numbers) for _ in range(n)] for _ in range(m)], dtype=float)
    cost = np.array([data.draw(st.integers(1, 9)) for _ in range(n)], dtype=float)
    lower = np.array([data.draw(st.integers(0, 20)) for _ in range(m)], dtype=float)
    width = [data.draw(st.one_of(st.none(), st.integers(0, 20))) for _ in range(m)]
    upper = lower + np.array([np.inf if w is None else w for w in width])
    status, x, y, w = solve(cost, amounts, lower, upper)
    best = corners(cost, amounts, lower, upper)
    if best is None:
        assert status == "infeasible" and w == 0
    else:
        assert status == "optimal" and w == 1
        assert cost @ x == pytest.approx(best, abs=1e-6)
        assert (cost - y @ amounts > -1e-6).all()
        bound = sum(v * (lower[i] if v > 0 else upper[i]) for i, v in enumerate(y) if abs(v) > 1e-12)
        assert bound == pytest.approx(best, abs=1e-6)


def test_simplex_edges():
    none = np.array([np.inf])
    assert solve(np.array([-1.0]), np.array([[0.0]]), np.array([-np.inf]), none)[0] == "unbounded"
    assert solve(np.array([-1.0]), np.array([[1.0]]), np.array([0.0]), none)[0] == "unbounded"
    assert solve(np.array([1.0]), np.zeros((1, 1)), np.array([1.0]), none)[0] == "infeasible"
    assert solve(np.zeros(0), np.zeros((1, 0)), np.array([0.0]), none)[0] == "optimal"
    assert solve(np.zeros(0), np.zeros((1, 0)), np.array([1.0]), none)[0] == "infeasible"
    status, x, _, _ = solve(np.array([-1.0, 1.0]), np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([0.0, 2.0]), np.array([3.0, 2.0]))
    assert status == "optimal" and list(x) == [3.0, 2.0]


@pytest.fixture(scope="module")
def candidates(spark):
    """Scenario 'hot' has 3,000 of 3,200 candidates."""
    rng = random.Random(3)
    rows = []
    for i in range(3200):
        scenario = "hot" if i < 3000 else rng.choice(["a", "b", "poor"])
        rows.append((scenario, i, rng.uniform(0.1, 5.0), rng.uniform(0, 30), rng.choice([0.0, rng.uniform(0, 50)]), rng.uniform(50, 600)))
    rows.append(("a", 9000, None, 1.0, 1.0, 1.0))
    return spark.createDataFrame(rows, "scenario string, item long, objective double, protein double, fat double, energy double").repartition(6)


@pytest.fixture(scope="module")
def bounds(spark):
    asked = [("protein", 90.0, 150.0), ("fat", 20.0, 70.0), ("energy", 2000.0, 2100.0)]
    rows = [(s, *b) for s in ("hot", "a", "b") for b in asked]
    rows += [("poor", "protein", 100.0, None), ("poor", "energy", None, 10.0), ("empty", "fat", 1.0, None), ("idle", "fat", 0.0, 5.0)]
    rows += [("crossed", "fat", 5.0, 1.0)]
    return spark.createDataFrame(rows, "scenario string, nutrient_id string, lower double, upper double")


NUTRIENTS = ["protein", "fat", "energy"]


@pytest.fixture(scope="module")
def solved(candidates, bounds):
    return D.optimize_diets(candidates, bounds, NUTRIENTS, per_round=10)


def test_status_of_each_scenario(solved):
    status = {r.scenario: r.status for r in solved.scenarios.collect()}
    assert status == {
        "hot": "optimal", "a": "optimal", "b": "optimal", "poor": "infeasible", "empty": "infeasible",
        "idle": "optimal", "crossed": "infeasible",
    }
    assert {r.scenario: r.objective for r in solved.scenarios.collect()}["idle"] == 0.0


def test_certificate(solved, bounds, spark):
    rows = {r.scenario: r for r in D.certificate(solved, bounds).collect()}
    assert len(rows) == 7 and all(r.proven for r in rows.values()), rows
    assert rows["poor"].dual_bound > 0 and rows["poor"].gap is None and rows["hot"].gap < 1e-6
    # Another bound than the one solved for is not proven by the same solution.
    harder = bounds.withColumn("lower", F.col("lower") * 1.01)
    assert not {r.scenario: r.proven for r in D.certificate(solved, harder).collect()}["hot"]


def test_same_as_one_programme_over_all_candidates(solved, candidates):
    lower, upper = np.array([90.0, 20.0, 2000.0]), np.array([150.0, 70.0, 2100.0])
    values = {r.scenario: r.objective for r in solved.scenarios.collect()}
    for scenario in ("hot", "a"):
        pdf = candidates.where(F.col("scenario") == scenario).where("objective IS NOT NULL").toPandas()
        status, x, _, _ = solve(pdf["objective"].to_numpy(), pdf[NUTRIENTS].to_numpy().T, lower, upper)
        assert status == "optimal" and values[scenario] == pytest.approx(float(pdf["objective"] @ x), rel=1e-6)


def test_scenarios_that_share_places_share_candidates(candidates, bounds, solved):
    """Two scenarios with the same bounds at the same places: the same diets, and each candidate stored once."""
    asked = bounds.where("scenario = 'hot'")
    twice = asked.withColumn("scenario", F.explode(F.array(F.lit("one"), F.lit("two"))))
    shops = twice.select("scenario", F.lit("hot").alias("place")).distinct()
    places = candidates.withColumnRenamed("scenario", "place")
    both = D.optimize_diets(places, twice, NUTRIENTS, shops, per_round=10)
    one = D.optimize_diets(places, asked, NUTRIENTS, shops.where("scenario = 'one'").withColumn("scenario", F.lit("hot")), per_round=10)
    values = {r.scenario: r.objective for r in both.scenarios.collect()}
    hot = {r.scenario: r.objective for r in solved.scenarios.collect()}["hot"]
    assert values == pytest.approx({"one": hot, "two": hot})
    assert both.pool.count() == one.pool.count()
    assert all(r.proven for r in D.certificate(both, twice).collect())


def test_unknown_nutrients_are_refused(candidates, bounds):
    with pytest.raises(ValueError, match="energy"):
        D.optimize_diets(candidates, bounds, ["protein", "fat"])


def test_only_results_are_left_behind(spark, candidates, bounds):
    from pathlib import Path

    from larder.runtime import shared_folder

    before = set(Path(shared_folder(spark)).iterdir())
    D.optimize_diets(candidates, bounds, NUTRIENTS, per_round=5)
    assert len(set(Path(shared_folder(spark)).iterdir()) - before) == 3  # result, pool, shops


def test_pricing_ranks_within_partitions_first(candidates, bounds):
    limits, pool = D._limits(bounds, NUTRIENTS), D._pool(candidates.withColumnRenamed("scenario", "place"), NUTRIENTS)
    shops = limits.select("scenario", F.col("scenario").alias("place"))
    duals = limits.select("scenario", F.lit("optimal").alias("status"), F.lit(1.0).alias("weight"), F.col("upper").alias("duals"))
    plan = D._entering(pool, shops, duals, 3, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_many_rounds_end(candidates, bounds, solved):
    slow = D.optimize_diets(candidates, bounds, NUTRIENTS, per_round=1)
    rows = {r.scenario: r for r in slow.scenarios.collect()}
    assert rows["hot"].rounds > 2
    assert {s: r.objective for s, r in rows.items()} == pytest.approx({r.scenario: r.objective for r in solved.scenarios.collect()})


def test_binding_constraints(solved, bounds):
    levels = {(r.scenario, r.nutrient_id): r.level for r in D.nutrient_levels(solved).collect()}
    binding = {(r.scenario, r.nutrient_id) for r in D.binding_constraints(solved, bounds).collect()}
    for row in bounds.where("scenario IN ('hot', 'a', 'b')").collect():
        level = levels[(row.scenario, row.nutrient_id)]
        assert ((row.scenario, row.nutrient_id) in binding) == (min(abs(level - row.lower), abs(row.upper - level)) <= 1e-3)
    assert ("idle", "fat") in binding


def test_report(solved, spark):
    offers = solved.quantities.select(
        "item", F.col("item").alias("price_id"), F.lit("code").alias("product_code"), F.lit("name").alias("product_name"),
        F.lit(1).alias("ciqual_code"), F.lit("food").alias("ciqual_name"), F.lit("#ffffff").alias("color"), F.lit(2.0).alias("price"),
        F.lit("Shop, Street, Town, Country").alias("location_osm_display_name"), F.lit(5).alias("location_osm_id"),
    ).distinct()
    report = D.diet_report(solved, offers)
    rows = report.where("scenario = 'hot'").collect()
    assert rows and rows[0].location == "Shop, Street, Town"
    assert [r.quantity_g for r in rows] == sorted((r.quantity_g for r in rows), reverse=True)
    levels = {r.nutrient_id: r.level for r in D.nutrient_levels(solved).where("scenario = 'hot'").collect()}
    assert sum(r.protein for r in rows) == pytest.approx(levels["protein"], abs=0.01)
    total = R.total_price(report, ["scenario"]).where("scenario = 'hot'").first().total_price
    assert total == pytest.approx(sum(r.price for r in rows))
    ranked = report.withColumn("rank", F.monotonically_increasing_id()).withColumn("carbohydrate", F.lit(0.0))
    shares = R.macro_summary(ranked, ["scenario"]).where("scenario = 'hot'").collect()
    assert sum(r.percent for r in shares) == pytest.approx(100.0)


def test_matrix(candidates):
    rows = D.lp_input_matrix(candidates.where("item = 5"), "item", NUTRIENTS).orderBy("row").collect()
    assert [r.nutrient_id for r in rows] == NUTRIENTS and rows[0].row == 0


def test_candidate_products(spark):
    columns = {c: F.lit(None).cast("string") for c in D.OFFER_COLUMNS if c not in ("price_id", "price")}
    mart = spark.createDataFrame(
        [(1, 10, 2.0, 100.0, 4.0), (2, 11, 2.0, 100.0, 4.0), (3, 10, None, 100.0, 1.0), (4, 10, 0.0, 1.0, 1.0), (5, 10, 1.0, 0.0, 1.0)],
        "price_id int, location_id int, price double, product_quantity double, protein double",
    ).withColumns(columns)
    locations = spark.createDataFrame([(10,), (10,)], "location_id int")
    rows = D.candidate_products(mart, locations, ["protein"], "price / protein").collect()
    assert [(r.price_id, r.objective, r.protein) for r in rows] == [(1, 0.5, 4.0)]
    places = D.place_candidates(mart, ["protein"], "price", F.col("price_id")).collect()
    assert sorted((r.place, r.item) for r in places) == [(10, 1), (11, 2)]


def test_report_tells_repeated_price_ids_apart(spark):
    """Two offers share a price_id; the report names the one that was bought."""
    mart = spark.createDataFrame(
        [(1, "dear", 10, 9.0, 100.0, 4.0), (1, "cheap", 10, 2.0, 100.0, 4.0)],
        "price_id int, product_code string, location_id int, price double, product_quantity double, protein double",
    ).withColumns({c: F.lit(None).cast("string") for c in D.OFFER_COLUMNS if c not in ("price_id", "product_code", "price")})
    item = F.concat_ws("-", "price_id", "product_code")
    bounds = spark.createDataFrame([("s", "protein", 8.0, None)], "scenario string, nutrient_id string, lower double, upper double")
    shops = spark.createDataFrame([("s", 10)], "scenario string, place int")
    solved = D.optimize_diets(D.place_candidates(mart, ["protein"], "price", item), bounds, ["protein"], shops)
    rows = D.diet_report(solved, mart.withColumn("item", item)).collect()
    assert [(r.id, r.product_code, r.price, r.quantity_g) for r in rows] == [(1, "cheap", 4.0, 200.0)]


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_a_later_basis_starts_from_the_last(data):
    """Columns that come in later: the optimum from the old basis is that from none, and feasibility is not lost."""
    n, m = data.draw(st.integers(2, 8)), data.draw(st.integers(1, 4))
    draw = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    amounts, cost = draw.integers(0, 9, (m, n)).astype(float), draw.integers(1, 30, n).astype(float)
    lower = draw.integers(0, 20, m).astype(float)
    upper = lower + np.where(draw.random(m) < 0.3, np.inf, draw.integers(0, 20, m).astype(float))
    some = data.draw(st.integers(1, n - 1))
    first = solve_from(cost[:some], amounts[:, :some], lower, upper)
    cold, warm = solve_from(cost, amounts, lower, upper), solve_from(cost, amounts, lower, upper, first.basis)
    assert warm.status == cold.status and warm.weight == cold.weight
    if first.status == "optimal":
        assert warm.status == "optimal" and cost @ warm.x <= cost[:some] @ first.x + 1e-6
    if cold.status == "optimal":
        assert cost @ warm.x == pytest.approx(cost @ cold.x, abs=1e-6)
        assert (cost - warm.prices @ amounts > -1e-6).all()
    again = solve_from(cost, amounts, lower, upper, warm.basis)
    assert again.steps == 0 and again.status == warm.status


def test_warm_starts_save_steps():
    draw = np.random.default_rng(5)
    m, n = 12, 400
    amounts, cost = draw.random((m, n)) * 50, draw.random(n) * 5 + 0.1
    lower = draw.random(m) * 50 + 100
    upper = lower * 1.3
    first = solve_from(cost[:380], amounts[:, :380], lower, upper)
    cold, warm = solve_from(cost, amounts, lower, upper), solve_from(cost, amounts, lower, upper, first.basis)
    assert cost @ warm.x == pytest.approx(cost @ cold.x, rel=1e-9)
    assert warm.steps < cold.steps / 2


def test_rounds_go_on_from_the_last_basis(candidates, bounds, monkeypatch):
    """Pivots of all rounds together are fewer than where each round starts anew."""

    def total(diets):
        return {r.scenario: (r.steps, r.rounds, r.status) for r in diets.scenarios.collect()}

    warm = total(D.optimize_diets(candidates, bounds, NUTRIENTS, per_round=1))
    monkeypatch.setattr(D, "_known_basis", lambda row, items: None)
    cold = total(D.optimize_diets(candidates, bounds, NUTRIENTS, per_round=1))
    assert {s: v[2] for s, v in warm.items()} == {s: v[2] for s, v in cold.items()}
    assert max(v[1] for v in warm.values()) >= 3
    assert sum(v[0] for v in warm.values()) < 0.7 * sum(v[0] for v in cold.values())


def test_bounds_are_computed_once(spark, candidates):
    """Bounds may come from a query as large as the candidates' own."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    schema = "scenario string, nutrient_id string, lower double, upper double"
    rows = spark.createDataFrame([(s, "protein", 90.0, 150.0) for s in ("hot", "a", "b")], schema).mapInPandas(counted, schema)
    solved = D.optimize_diets(candidates, rows, NUTRIENTS)
    assert {r.status for r in solved.scenarios.collect()} == {"optimal"}
    assert seen.value == 3
