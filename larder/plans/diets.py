"""Cheapest diets for many scenarios at once, by column generation.

Candidates never gather in one task, and are stored once per place, however many scenarios
buy there. Each round, a small programme per scenario is solved over the columns chosen so far;
its duals, a few numbers, go to the candidates of its places, where every row computes its own
reduced cost; the best few per scenario join the columns. When no row anywhere has a negative reduced cost, the
solution is optimal for the whole table, which is the proof linear programming gives.

A scenario's last basis goes with its bounds, and the next round starts from it: what came in since is all there is to do.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.objective import compile_objective
from larder.operators.joins import salted_join
from larder.plans.simplex import Basis, Solved, solve_from
from larder.runtime import Scratch

PRICING_TOLERANCE = 1e-7
BINDING = 1e-3
SHOWN = 1e-3

# Columns of the bought quantities and the parallel arrays they travel in.
BOUGHT = {"item": "items", "quantity": "quantities", "cost": "costs", "amounts": "contents"}

#: Columns a scenario's last basis travels in.
BASIS = ("basis_items", "basis_levels", "raised")

OFFER_COLUMNS = [
    "price_id", "product_code", "product_name", "ciqual_code", "ciqual_name", "color", "price",
    "location_osm_display_name", "location_osm_id",
]


@dataclass(frozen=True)
class Diets:
    """scenarios: (scenario, status, objective, rounds, steps, duals), steps being pivots over all rounds; quantities: (scenario, item, quantity, cost, amounts).

    pool: (place, item, cost, amounts), the candidates that were priced; shops: (scenario, place).
    """

    scenarios: DataFrame
    quantities: DataFrame
    pool: DataFrame
    shops: DataFrame
    nutrients: list[str]


def candidate_products(mart: DataFrame, locations: DataFrame, nutrients: list[str], objective: str) -> DataFrame:
    """Offers at any of the given locations, with the objective and the chosen nutrients as columns."""
    offers = mart.where("price IS NOT NULL AND price > 0 AND product_quantity > 0")
    return offers.join(locations.select("location_id"), "location_id", "left_semi").select(
        compile_objective(objective, mart.schema).alias("objective"), *nutrients, *OFFER_COLUMNS
    )


def place_candidates(mart: DataFrame, nutrients: list[str], objective: str, item: Column) -> DataFrame:
    """(place, item, objective, nutrients...): every offer once; `item` has to tell offers apart."""
    return mart.where("price IS NOT NULL AND price > 0 AND product_quantity > 0").select(
        F.col("location_id").alias("place"), item.alias("item"), compile_objective(objective, mart.schema).alias("objective"), *nutrients
    )


def lp_input_matrix(candidates: DataFrame, item: str, nutrients: list[str]) -> DataFrame:
    """Coefficients in long form: (item, row, nutrient_id, amount), amounts as 32-bit floats."""
    amounts = F.array(*[F.coalesce(F.col(n).cast("float"), F.lit(0.0).cast("float")) for n in nutrients])
    names = F.array(*[F.lit(n) for n in nutrients])
    long = candidates.select(item, F.posexplode(amounts).alias("row", "amount"))
    return long.select(item, "row", F.get(names, F.col("row")).alias("nutrient_id"), "amount")


def optimize_diets(
    candidates: DataFrame, bounds: DataFrame, nutrients: list[str], shops: DataFrame | None = None, per_round: int | None = None
) -> Diets:
    """Cheapest quantities (in 100 g) per scenario within its nutrient bounds.

    candidates: (place, item, objective, one column per nutrient), and shops: (scenario, place), where a
    scenario may buy; or candidates with a scenario of their own in place of a place, and no shops.
    bounds: (scenario, nutrient_id, lower, upper), a NULL side being open. Scenarios that cannot be met
    come back as 'infeasible', those with no finite optimum as 'unbounded', and those in which numbers
    of too different size stop the solver as 'unsolved'; only 'optimal' ones have quantities.

    Rounds end when no candidate of a scenario would lower its objective. Each round adds candidates
    that were not among its columns, so they end. Tables written on the way are deleted.
    Inputs are computed once each: bounds and shops may be drawn from as large a table as candidates.
    """
    scratch = Scratch(bounds.sparkSession)
    bounds = scratch.table(bounds)
    unknown = bounds.where(~F.coalesce(F.col("nutrient_id").isin(nutrients), F.lit(False))).select("nutrient_id").first()
    if unknown:
        scratch.close()
        raise ValueError(f"a bound is on {unknown[0]!r}, which is not among the nutrients {nutrients}")
    item_type = candidates.schema["item"].dataType
    if shops is None:
        candidates = candidates.withColumnRenamed("scenario", "place")
        shops = bounds.select("scenario", F.col("scenario").alias("place"))
    k = per_round or 2 * len(nutrients) + 20
    limits = _limits(bounds, nutrients).withColumn("steps", F.lit(0))
    limits = scratch.table(limits.withColumns({c: F.lit(None).cast(kind) for c, kind in _basis_types(item_type).items()}))
    shops = scratch.table(shops.select("scenario", "place").distinct().join(limits.select("scenario"), "scenario", "left_semi"))
    pool = scratch.table(_pool(candidates, nutrients))
    columns = scratch.table(_seed(pool, shops, nutrients))
    open_limits, finished = limits, []
    round_no = 0
    while True:
        round_no += 1
        solved = scratch.table(_solve(open_limits, columns, item_type, round_no))
        known = columns.select("scenario", "item")
        better = _entering(pool, shops, solved, len(nutrients), k)
        entering = scratch.table(better.join(known, ["scenario", "item"], "left_anti"))
        improving = entering.select("scenario").distinct()
        finished.append(solved.join(improving, "scenario", "left_anti"))
        if entering.isEmpty():
            break
        merged = scratch.table(columns.join(improving, "scenario", "left_semi").union(entering.select(columns.columns)))
        still = open_limits.drop("steps", *BASIS).join(solved.select("scenario", "steps", *BASIS), "scenario")
        still = scratch.table(still.join(improving, "scenario", "left_semi"))
        # What is finished is written apart, so that a round's tables can go.
        finished[-1] = scratch.table(finished[-1])
        scratch.drop(solved, entering, columns, *([open_limits] if open_limits is not limits else []))
        columns, open_limits = merged, still
    result = scratch.table(reduce(DataFrame.union, finished))
    scratch.close(result, pool, shops)
    bought = F.arrays_zip(*BOUGHT.values())
    quantities = result.where(F.col("status") == "optimal").select("scenario", F.inline(bought))
    quantities = quantities.withColumnsRenamed({array: name for name, array in BOUGHT.items()})
    return Diets(result.drop("weight", *BOUGHT.values(), *BASIS), quantities, pool, shops, nutrients)


def _limits(bounds: DataFrame, nutrients: list[str]) -> DataFrame:
    """(scenario, lower[], upper[]) in the order of `nutrients`; of repeated bounds the tighter ones hold."""
    one_each = bounds.groupBy("scenario", "nutrient_id").agg(
        F.max("lower").cast("double").alias("lower"), F.min("upper").cast("double").alias("upper")
    )
    wide = one_each.groupBy("scenario").pivot("nutrient_id", nutrients).agg(
        F.first(F.struct("lower", "upper"), ignorenulls=True)
    )
    lower = [F.coalesce(F.col(f"`{n}`.lower"), F.lit(float("-inf"))) for n in nutrients]
    upper = [F.coalesce(F.col(f"`{n}`.upper"), F.lit(float("inf"))) for n in nutrients]
    return wide.select("scenario", F.array(*lower).alias("lower"), F.array(*upper).alias("upper"))


def _pool(candidates: DataFrame, nutrients: list[str]) -> DataFrame:
    """Candidates with their amounts as an array. Of equal amounts only a place's cheapest can be in an optimum."""
    contents = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"_{i}") for i, n in enumerate(nutrients)]
    shaped = candidates.where("place IS NOT NULL AND item IS NOT NULL AND objective IS NOT NULL").select(
        "place", "item", F.col("objective").cast("double").alias("cost"), *contents
    )
    same = [f"_{i}" for i in range(len(nutrients))]
    best = shaped.groupBy("place", *same).agg(F.min(F.struct("cost", "item")).alias("_best"))
    return best.select("place", "_best.item", "_best.cost", F.array(*same).alias("amounts"))


def _seed(pool: DataFrame, shops: DataFrame, nutrients: list[str]) -> DataFrame:
    """For each scenario and nutrient, the column that gives most of it for its cost: a place's best, then the best of its places."""

    def best_first(i: int) -> Column:
        amount = F.get("amounts", F.lit(i))
        return F.when(amount > 0, F.struct((F.col("cost") / amount).alias("ratio"), "item", "cost", "amounts"))

    names = [f"_{i}" for i in range(len(nutrients))]
    by_place = pool.groupBy("place").agg(*[F.min(best_first(i)).alias(n) for i, n in enumerate(names)])
    best = shops.join(by_place, "place").groupBy("scenario").agg(*[F.min(n).alias(n) for n in names])
    picked = F.filter(F.array(*names), lambda c: c.isNotNull())
    chosen = F.array_distinct(F.transform(picked, lambda c: F.struct(c["item"].alias("item"), c["cost"].alias("cost"), c["amounts"].alias("amounts"))))
    return best.select("scenario", F.inline(chosen))


def _solve(limits: DataFrame, columns: DataFrame, item_type: T.DataType, round_no: int) -> DataFrame:
    schema = T.StructType(
        [
            limits.schema["scenario"],
            T.StructField("status", T.StringType()),
            T.StructField("objective", T.DoubleType()),
            T.StructField("rounds", T.IntegerType()),
            T.StructField("weight", T.DoubleType()),
            T.StructField("duals", T.ArrayType(T.DoubleType())),
            T.StructField("items", T.ArrayType(item_type)),
            T.StructField("quantities", T.ArrayType(T.DoubleType())),
            T.StructField("costs", T.ArrayType(T.DoubleType())),
            T.StructField("contents", T.ArrayType(T.ArrayType(T.DoubleType()))),
            T.StructField("steps", T.IntegerType()),
            *[T.StructField(name, kind) for name, kind in _basis_types(item_type).items()],
        ]
    )

    def one_scenario(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lower, upper = np.array(rows["lower"].iloc[0]), np.array(rows["upper"].iloc[0])
        known = rows[rows["cost"].notna()].sort_values(["item", "cost"])
        cost = known["cost"].to_numpy("float64")
        amounts = np.array(known["amounts"].tolist(), dtype="float64").reshape(len(known), len(lower)).T
        items, last = known["item"].tolist(), rows.iloc[0]
        if (lower > upper).any():
            got = Solved("infeasible", np.zeros(len(known)), np.zeros(len(lower)), 0.0, Basis([], [False] * len(lower)))
        else:
            got = solve_from(cost, amounts, lower, upper, _known_basis(last, items))
        value = float(cost @ got.x) if got.status == "optimal" else None
        used = np.flatnonzero(got.x > 0)
        bought = ([items[k] for k in used], got.x[used], cost[used], amounts.T[used].tolist())
        members, raised = (got.basis.members, got.basis.raised) if got.basis else ([], [])
        basis = ([items[v] if v >= 0 else None for v in members], [-1 if v >= 0 else -1 - v for v in members], raised)
        steps = int(last["steps"]) + got.steps
        return pd.DataFrame([(key[0], got.status, value, round_no, got.weight, got.prices, *bought, steps, *basis)], columns=schema.names)

    rows = limits.join(columns, "scenario", "left")
    return rows.groupBy("scenario").applyInPandas(one_scenario, schema)


def _basis_types(item_type: T.DataType) -> dict[str, T.DataType]:
    """A basis in columns: its items, null for a nutrient's level; that nutrient, -1 for an item; levels on their upper bound."""
    return dict(zip(BASIS, (T.ArrayType(item_type), T.ArrayType(T.IntegerType()), T.ArrayType(T.BooleanType())), strict=True))


def _known_basis(row: pd.Series, items: list) -> Basis | None:
    names, levels, raised = (row[c] for c in BASIS)
    if levels is None or not len(levels):
        return None
    place = {item: k for k, item in enumerate(items)}
    return Basis([place[i] if n < 0 else -1 - int(n) for i, n in zip(names, levels, strict=True)], [bool(r) for r in raised])


def _priced(pool: DataFrame, shops: DataFrame, duals: DataFrame) -> DataFrame:
    """The candidates of each scenario's places beside its duals; places without one of these scenarios drop out."""
    return salted_join(pool, shops.join(duals, "scenario"), "place", "item")


def _entering(pool: DataFrame, shops: DataFrame, solved: DataFrame, size: int, k: int) -> DataFrame:
    """The k most promising candidates of each scenario that would lower its objective (or its infeasibility).

    `row_number() <= k` is applied inside every partition before the shuffle, so a
    scenario with a third of all candidates sends k rows per partition like any other.
    """
    duals = solved.where(F.col("status").isin("optimal", "infeasible")).select("scenario", "weight", "duals")
    terms = [F.get("duals", F.lit(i)) * F.get("amounts", F.lit(i)) for i in range(size)]
    weighed = F.col("weight") * F.col("cost")
    reduced = weighed - sum(terms[1:], terms[0])
    magnitude = F.abs(weighed) + sum((F.abs(t) for t in terms[1:]), F.abs(terms[0]))
    scored = (
        _priced(pool, shops, duals)
        .select("scenario", "item", "cost", "amounts", reduced.alias("_reduced"), magnitude.alias("_size"))
        .where(F.col("_reduced") < -PRICING_TOLERANCE * F.col("_size"))
        .withColumn("_score", F.col("_reduced") / F.col("_size"))
    )
    rank = F.row_number().over(Window.partitionBy("scenario").orderBy("_score", "item"))
    return scored.withColumn("_rank", rank).where(F.col("_rank") <= k).select("scenario", "item", "cost", "amounts")


def nutrient_levels(diets: Diets) -> DataFrame:
    """(scenario, nutrient_id, level): what the chosen quantities add up to."""
    names = F.array(*[F.lit(n) for n in diets.nutrients])
    long = diets.quantities.select("scenario", "quantity", F.posexplode("amounts").alias("_i", "amount"))
    return long.groupBy("scenario", F.get(names, F.col("_i")).alias("nutrient_id")).agg(
        F.sum(F.col("quantity") * F.col("amount")).alias("level")
    )


def binding_constraints(diets: Diets, bounds: DataFrame, within: float = BINDING) -> DataFrame:
    """Nutrients of solved scenarios whose level sits on one of its bounds."""
    optimal = diets.scenarios.where("status = 'optimal'").select("scenario")
    asked = bounds.join(optimal, "scenario", "left_semi")
    leveled = asked.join(nutrient_levels(diets), ["scenario", "nutrient_id"], "left").withColumn(
        "level", F.coalesce("level", F.lit(0.0))
    )
    at_lower = F.coalesce(F.abs(F.col("level") - F.col("lower")) <= within, F.lit(False))
    at_upper = F.coalesce(F.abs(F.col("upper") - F.col("level")) <= within, F.lit(False))
    return leveled.where(at_lower | at_upper).select("scenario", "nutrient_id").distinct()


def certificate(diets: Diets, bounds: DataFrame, within: float = 1e-6) -> DataFrame:
    """Proof of each scenario's status, computed over its whole candidate pool.

    Optimal: no bound is missed (shortfall), no candidate would improve (worst_reduced_cost)
    and the objective meets the dual bound (gap). Infeasible: weighing the bounds by the duals gives a
    sum that no candidate can contribute to, yet it has to be positive (dual_bound). All
    measures are relative; `proven` is their verdict.
    """
    n = diets.nutrients
    known = diets.scenarios.where("status IN ('optimal', 'infeasible')")
    is_optimal = F.col("status") == "optimal"
    asked = bounds.join(nutrient_levels(diets), ["scenario", "nutrient_id"], "left")
    level = F.coalesce("level", F.lit(0.0))
    missed = F.greatest(
        F.coalesce(F.col("lower") - level, F.lit(0.0)), F.coalesce(level - F.col("upper"), F.lit(0.0)), F.lit(0.0)
    )
    names = F.array(*[F.lit(x) for x in n])
    dual = F.get("duals", F.array_position(names, F.col("nutrient_id")).cast("int") - 1)
    priced_bound = F.when(dual > 0, dual * F.col("lower")).when(dual < 0, dual * F.col("upper")).otherwise(0.0)
    met = asked.join(known.select("scenario", "duals"), "scenario").groupBy("scenario").agg(
        F.max(missed / F.greatest(F.abs(level), F.lit(1.0))).alias("shortfall"),
        F.sum(priced_bound).alias("dual_bound"),
        F.max(F.coalesce(F.col("lower") > F.col("upper"), F.lit(False))).alias("_crossed"),
    )
    duals = known.select("scenario", "status", "duals")
    priced = _priced(diets.pool, diets.shops, duals)
    cost = F.when(is_optimal, F.col("cost")).otherwise(0.0)
    terms = [F.get("duals", F.lit(i)) * F.get("amounts", F.lit(i)) for i in range(len(n))]
    size = F.abs(cost) + sum((F.abs(t) for t in terms[1:]), F.abs(terms[0]))
    reduced = F.try_divide(cost - sum(terms[1:], terms[0]), size)
    worst = priced.groupBy("scenario").agg(F.min(reduced).alias("worst_reduced_cost"))
    gap = F.abs(F.col("objective") - F.col("dual_bound")) / F.greatest(F.abs("objective"), F.lit(1.0))
    measured = known.join(met, "scenario").join(worst, "scenario", "left").select(
        "scenario",
        "status",
        "objective",
        F.when(is_optimal, F.col("shortfall")).alias("shortfall"),
        F.coalesce(F.least("worst_reduced_cost", F.lit(0.0)), F.lit(0.0)).alias("worst_reduced_cost"),
        "dual_bound",
        F.when(is_optimal, gap).alias("gap"),
        "_crossed",
    )
    nothing_better = F.col("worst_reduced_cost") > -within
    optimal = (F.col("shortfall") < within) & nothing_better & (F.col("gap") < within)
    infeasible = F.col("_crossed") | (nothing_better & (F.col("dual_bound") > 0))
    return measured.withColumn("proven", F.when(is_optimal, optimal).otherwise(infeasible)).drop("_crossed")


def diet_report(diets: Diets, offers: DataFrame) -> DataFrame:
    """The shopping list of each scenario, largest quantities first; `offers` has one row per item."""
    n = diets.nutrients
    bought = diets.quantities.where(F.col("quantity") > SHOWN)
    described = bought.join(offers.select("item", *OFFER_COLUMNS), "item")
    contribution = [F.bround(F.get("amounts", F.lit(i)) * F.col("quantity"), 4).alias(x) for i, x in enumerate(n)]
    return described.select(
        "scenario",
        F.col("price_id").alias("id"),
        "product_code",
        "product_name",
        "ciqual_name",
        "ciqual_code",
        "color",
        F.substring_index("location_osm_display_name", ", ", 3).alias("location"),
        "location_osm_id",
        F.bround(100 * F.col("quantity"), 1).alias("quantity_g"),
        F.bround(F.col("price") * F.col("quantity"), 2).alias("price"),
        *contribution,
    ).orderBy("scenario", F.desc("quantity_g"))
