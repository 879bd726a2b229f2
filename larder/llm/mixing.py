"""Mixing sources to target weights.

Weights are the sources' token shares raised to one exponent and normalised: 1 keeps the corpus as it
is, 0 makes all sources equal. The exponent is bisected until the weights reach an entropy; without one,
until they keep a bound on repetition. With both, passes over a source beyond the bound are cut off, and what
is left of the budget goes to the other sources. A budget of tokens then turns weights into passes: a
source's documents lie in blocks, each pass is a fresh permutation of its blocks, and the pass that ends inside a source takes whole
blocks in that order and, of the block in which the budget ends, documents in a random order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.runtime import materialize

BLOCKS = 1024  # blocks a source is dealt into
STEPS = 32  # exponents tried in one job


@dataclass(frozen=True)
class Mix:
    """What weights have to meet. With both limits, the bound on repetition is kept first: see weights.

    entropy: share of the greatest possible entropy, 0 to 1. repeats: most passes over any source.
    budget: tokens to deal out, as a multiple of the corpus; None: just enough that each document of
    every source is dealt at least once.
    """

    entropy: float | None = None
    repeats: float | None = None
    budget: float | None = None


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    # Each run ends in a white-space character once one is appended; count the ends.
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\t-\r ]++")), F.lit(0)).cast("long")


def _key(source: str) -> Column:
    """Null is a source of its own."""
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source).cast("string")))


def exponent(totals: DataFrame, mix: Mix) -> float:
    """The exponent in [0, 1] for a table of (source_key, size). Only sums over sources reach the driver.

    Entropy falls as the exponent grows, and so do repetitions: the largest exponent that reaches the
    entropy is wanted, and where none is asked for the smallest that keeps within the repetitions. Where a
    limit can't be met even at the end of the range, that end is used.
    """
    sized = totals.where("size > 0")
    corpus = sized.agg(F.sum("size"), F.min("size"), F.max("size"), F.count("*")).first()
    if not corpus[3]:
        return 1.0
    whole, least, most, sources = float(corpus[0]), float(corpus[1]), float(corpus[2]), corpus[3]
    share = F.col("size") / F.lit(whole)

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        columns = [F.sum(x) for a in exponents for x in (F.pow(share, F.lit(a)), F.pow(share, F.lit(a)) * F.log(share))]
        got = sized.agg(*columns).first()
        return list(zip(got[::2], got[1::2], strict=True))

    def entropy(a: float, z: float, weighted: float) -> float:
        return math.log(z) - a * weighted / z

    def passes(a: float, z: float) -> float:
        """Passes over the smallest source, which gets the most."""
        weight = (least / whole) ** a / z
        budget = mix.budget * whole if mix.budget is not None else most * z / (most / whole) ** a
        return weight * budget / least

    def bisect(holds) -> float:
        """The largest exponent for which `holds`; it holds at small exponents and not at large ones."""
        low, high = 0.0, 1.0
        for _ in range(5):
            grid = [low + (high - low) * k / (STEPS - 1) for k in range(STEPS)]
            good = [holds(a, *s) for a, s in zip(grid, sums(grid), strict=True)]
            if good[-1]:
                return grid[-1]
            if not good[0]:
                return grid[0]
            last = max(k for k, g in enumerate(good) if g)
            low, high = grid[last], grid[last + 1]
        return low

    found = 1.0
    if mix.entropy is not None and sources > 1:
        target = mix.entropy * math.log(sources)
        found = bisect(lambda a, z, w: entropy(a, z, w) >= target)
    elif mix.repeats is not None:
        # The smallest exponent within the bound is just above the largest one beyond it.
        beyond = bisect(lambda a, z, w: passes(a, z) > mix.repeats)
        kept = 0.0 if passes(0.0, float(sources)) <= mix.repeats else beyond
        found = kept
    return found


def _stretch(planned: DataFrame, budget: float, repeats: float) -> float:
    """How many times the passes of sources within the bound grow, so that all meet the budget with none beyond it.

    Bisected on sums over sources, a grid of factors in one job. Infinite if `repeats` passes over all don't fill it.
    """
    most = planned.agg(F.sum("size") * repeats).first()[0] or 0.0
    if budget >= most:
        return math.inf
    low, high = 1.0, 2.0

    def spent(factors: list[float]) -> list[float]:
        got = planned.agg(*[F.sum(F.col("size") * F.least(F.col("passes") * f, F.lit(repeats))) for f in factors]).first()
        return list(got)

    while spent([high])[0] < budget:
        low, high = high, high * 16
    for _ in range(8):
        grid = [low + (high - low) * k / (STEPS - 1) for k in range(STEPS)]
        last = max([k for k, s in enumerate(spent(grid)) if s <= budget], default=0)
        low, high = grid[last], grid[min(last + 1, STEPS - 1)]
    return low


def weights(totals: DataFrame, mix: Mix) -> DataFrame:
    """source_key, size, weight, passes (size times passes is the source's part of the budget) and share.

    weight is the source's at the exponent found, share its part of what is dealt: the two differ where passes are cut
    off at `repeats`. What that frees of a stated budget goes to the sources within the bound, in proportion to their
    weights; without a budget less is dealt. A source without tokens has weight 0 and is dealt once.
    """
    a = exponent(totals, mix)
    summed = totals.where("size > 0").agg(F.sum("size").alias("whole"), F.sum(F.pow("size", F.lit(a))).alias("z"), F.max("size").alias("most"))
    # One row of three sums, joined to each source.
    weight = F.when(F.col("size") > 0, F.pow("size", F.lit(a)) / F.col("z")).otherwise(0.0)
    budget = F.col("whole") * F.lit(mix.budget) if mix.budget is not None else F.col("most") * F.col("z") / F.pow("most", F.lit(a))
    planned = totals.join(F.broadcast(summed), how="cross").select(
        "source_key", "size", weight.alias("weight"), F.when(F.col("size") > 0, weight * budget / F.col("size")).otherwise(1.0).alias("passes")
    )
    if mix.repeats is not None:
        factor = 1.0
        if mix.budget is not None and not planned.where(F.col("passes") > mix.repeats * (1 + 1e-9)).isEmpty():
            factor = _stretch(planned, mix.budget * float(summed.first()["whole"]), mix.repeats)
        stretched = F.lit(mix.repeats) if math.isinf(factor) else F.least(F.col("passes") * factor, F.lit(mix.repeats))
        planned = planned.withColumn("passes", F.when(F.col("size") > 0, stretched).otherwise(F.col("passes")))
    planned = planned.withColumn("passes", F.round("passes", 9))
    dealt = planned.agg(F.sum(F.col("size") * F.col("passes")).alias("dealt"))
    share = F.when(F.col("dealt") > 0, F.col("size") * F.col("passes") / F.col("dealt")).otherwise(0.0)
    return planned.join(F.broadcast(dealt), how="cross").withColumn("share", share).drop("dealt")


def entropy_reached(weighted: DataFrame) -> float:
    """The entropy of the shares that are dealt, as a part of the greatest possible; 1 for a single source."""
    part = F.when(F.col("share") > 0, F.col("share") * F.log("share")).otherwise(0.0)
    found = weighted.where("size > 0").agg(F.sum(part).alias("sum"), F.count("*").alias("sources")).first()
    return 1.0 if found["sources"] < 2 else -found["sum"] / math.log(found["sources"])


def mix_sources(
    docs: DataFrame, mix: Mix, source: str = "source", doc_id: str = "doc_id", tokens: Column | None = None, text: str = "text", seed: int = 1
) -> DataFrame:
    """The rows of docs as dealt: each as often as its source's passes take it, with three more columns.

    epoch: which pass of the source; block: its block's place in that pass; place: a number by which
    rows of a block are ordered, other in each pass. Read in the order (epoch, block, place).

    tokens: a document's size; its words by default. Sizes of null or less count as 0. Rows with a null
    source form a source. Documents are dealt to blocks by a hash of doc_id and text, so repeated rows
    share their block, and each of them is dealt. Rows are read once for whole passes and once for the block in which
    a source's budget ends, 1/1024 of the source; only that block is ordered, in one task. Input columns
    named epoch, block or place are replaced.
    """
    kept = [c for c in docs.columns if c not in ("epoch", "block", "place")]
    size = F.greatest(F.coalesce(tokens if tokens is not None else word_count(docs[text]), F.lit(0)), F.lit(0)).cast("long")
    hashed = F.xxhash64(docs[doc_id], docs[text], F.lit(seed))
    rows = docs.select(*[docs[c] for c in kept], size.alias("__size"), hashed.alias("__hash"))
    rows = rows.withColumn("__key", _key(source)).withColumn("__block", F.pmod("__hash", F.lit(BLOCKS)))
    # Written once: the search for the exponent and the plan read sums of blocks, not documents.
    blocks = materialize(rows.groupBy("__key", "__block").agg(F.sum("__size").alias("tokens")))
    totals = blocks.groupBy(F.col("__key").alias("source_key")).agg(F.sum("tokens").alias("size"))
    planned = _plan(blocks, weights(totals, mix), seed)
    # A block's passes: whole ones, and in the last perhaps a part of `quota` tokens.
    own = (F.col("__key") == F.col("source_key")) & (F.col("__block") == F.col("own"))
    planned = materialize(planned)

    def dealt(passes: DataFrame) -> DataFrame:
        return rows.join(passes, own).withColumn("__draw", F.xxhash64("__hash", "epoch"))

    columns = [*[F.col(f"`{c}`") for c in kept], "epoch", "block", F.col("__draw").alias("place")]
    whole = dealt(planned.where("quota is null")).select(*columns)
    # Of the one block of a source in which its budget ends: documents up to the first that reaches it.
    order = Window.partitionBy("__key", "__block", "epoch").orderBy("__draw", "__size").rowsBetween(Window.unboundedPreceding, -1)
    part = dealt(planned.where("quota is not null")).withColumn("__before", F.coalesce(F.sum("__size").over(order), F.lit(0)))
    return whole.unionByName(part.where("__before < quota").select(*columns))


def _plan(blocks: DataFrame, weighted: DataFrame, seed: int) -> DataFrame:
    """source_key, own, epoch, block, quota: each block's passes. At most 1024 rows of a source meet in a task."""
    source = blocks.join(weighted, F.col("__key") == F.col("source_key"))
    each = source.select("source_key", "size", "passes", "tokens", F.col("__block").alias("own"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("passes") - 1, F.lit(0)).cast("int"))).alias("epoch"))
    turn = Window.partitionBy("source_key", "epoch").orderBy(F.xxhash64("own", "epoch", F.lit(seed)), "own")
    placed = each.withColumn("block", F.row_number().over(turn) - 1).withColumn(
        "before", F.coalesce(F.sum("tokens").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    left = F.round((F.col("passes") - F.col("epoch")) * F.col("size")).cast("long")  # tokens for this pass
    whole = (F.col("passes") >= F.col("epoch") + 1) | (F.col("before") + F.col("tokens") <= left)
    return placed.where(whole | (F.col("before") < left)).select(
        "source_key", "own", "epoch", "block", F.when(whole, F.lit(None)).otherwise(left - F.col("before")).alias("quota")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus dealt once more in size, to weights of 97 % of the greatest entropy, at most four passes over a source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    dealt = mix_sources(docs, Mix(entropy=0.97, repeats=4.0, budget=1.0))
    return dealt.select("doc_id", "source", "epoch", "block", "place")


QUERIES = {"op7_mixing": op7_mixing}
SQL: dict[str, str] = {}
