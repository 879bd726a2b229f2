"""Which points lie in which rectangles, for many of both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.geo import GRID_BITS, grid

#: A side of a rectangle is cut in at most one cell more than this.
PIECES = 4

#: Points times rectangles that one task compares; cells with more are dealt.
PAIRS = 1 << 25

CELL = ["level_x", "level_y", "cell_x", "cell_y"]


@dataclass(frozen=True)
class Plane:
    """The part of the plane that the grid divides. What lies beyond it counts to the cells at its edge."""

    x0: float
    y0: float
    x1: float
    y1: float


def levelled(rectangles: DataFrame, plane: Plane) -> DataFrame:
    """rectangles (x0, y0, x1, y1, sides included) with their sides on the grid and, for each axis, the size of their cells.

    level_x and level_y are the numbers of halvings by which cells are coarser than the grid: the least at which a
    side spans `PIECES` cells' width or less. Rectangles that hold no point, or have a NULL side, have no cells.
    """
    ends = {
        "_gx0": grid(F.col("x0"), plane.x0, plane.x1), "_gx1": grid(F.col("x1"), plane.x0, plane.x1),
        "_gy0": grid(F.col("y0"), plane.y0, plane.y1), "_gy1": grid(F.col("y1"), plane.y0, plane.y1),
    }
    placed = rectangles.where("x0 <= x1 AND y0 <= y1").withColumns(ends)

    def level(low: str, high: str) -> Column:
        # 2^level * PIECES >= size, counted by comparisons: whole numbers have no rounding. A NaN side has level 0 and no cell.
        size = F.col(high) - F.col(low) + 1
        return sum((F.coalesce(size > (PIECES << k), F.lit(False)).cast("int") for k in range(GRID_BITS)), F.lit(0))

    return placed.withColumns({"level_x": level("_gx0", "_gx1"), "level_y": level("_gy0", "_gy1")})


def covered(rectangles: DataFrame, plane: Plane) -> DataFrame:
    """rectangles with the cells (level_x, level_y, cell_x, cell_y) that cover each, (PIECES + 1)^2 at most.

    Cells are shaped like their rectangle, so what they hold beside it is a fraction of it, however long and thin it is.
    """

    def span(low: str, high: str, level: str) -> Column:
        return F.sequence(*[F.call_function("shiftright", F.col(end), F.col(level)) for end in (low, high)])

    # explode would have its whole expression tested where rectangles are read, in code too long to be compiled.
    columns = levelled(rectangles, plane).withColumn("cell_x", F.explode_outer(span("_gx0", "_gx1", "level_x")))
    return columns.withColumn("cell_y", F.explode_outer(span("_gy0", "_gy1", "level_y"))).drop("_gx0", "_gx1", "_gy0", "_gy1")


def _heavy(points: DataFrame, cover: DataFrame) -> DataFrame:
    """Cells in which more pairs meet than one task should compare: by how many `tasks`, and whether points are the more."""
    counts = [side.groupBy(*CELL).agg(F.count("*").alias(name)) for side, name in ((points, "_points"), (cover, "_rectangles"))]
    pairs = F.col("_points").cast("double") * F.col("_rectangles")
    both = counts[0].join(counts[1], CELL).withColumn("_tasks", F.ceil(pairs / PAIRS))
    return both.where("_tasks > 1").select(*CELL, "_tasks", (F.col("_points") > F.col("_rectangles")).alias("_by_points"))


def _hashed(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if "map<" not in rows.schema[c].dataType.simpleString()]  # maps have no hash


def _dealt(side: DataFrame, heavy: DataFrame, deal: Column, row: list[str]) -> DataFrame:
    """A heavy cell's rows of the side that is dealt go to one of its tasks each, those of the other side to all."""
    one = F.array(F.pmod(F.xxhash64(*_hashed(side.select(*row))), F.col("_tasks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("_tasks") - 1)
    task = F.when(F.col("_tasks").isNull(), F.array(F.lit(0).cast("long"))).when(deal, one).otherwise(every)
    return side.join(heavy, CELL, "left").withColumn("_task", F.explode(task)).drop("_tasks", "_by_points")


def points_in_rectangles(points: DataFrame, rectangles: DataFrame, plane: Plane) -> DataFrame:
    """Every point (x, y, ...) beside every rectangle (x0, y0, x1, y1, ...) that holds it.

    Points meet rectangles by equal cells: a point has one cell for each pair of levels that some rectangle has, at
    most 17 * 17. The exact comparison follows. What is compared is little more than what is found, and a cell with
    many of both is dealt over tasks. Columns of the two have to differ.
    """
    levels = levelled(rectangles, plane).select("level_x", "level_y").distinct().collect()  # 17 * 17 at most
    if not levels:
        return points.crossJoin(rectangles).where("false")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Files that hold few bytes of rows still make many cells: both sides are spread before, by hash, which sorts nothing.
    gx, gy = grid(F.col("x"), plane.x0, plane.x1), grid(F.col("y"), plane.y0, plane.y1)
    placed = points.where("x IS NOT NULL AND y IS NOT NULL").repartition(parts, *_hashed(points)).withColumns({"_gx": gx, "_gy": gy})
    every = F.array(*[F.struct(F.lit(a).alias("level_x"), F.lit(b).alias("level_y")) for a, b in sorted(map(tuple, levels))])
    at = {f"cell_{axis}": F.call_function("shiftright", F.col(f"_g{axis}"), F.col(f"level_{axis}")) for axis in "xy"}
    placed = placed.select("*", F.inline(every)).withColumns(at).drop("_gx", "_gy")
    cover = covered(rectangles.repartition(parts, *_hashed(rectangles)), plane)
    heavy = _heavy(placed, cover)
    key = [*CELL, "_task"]
    # A task's work is the pairs it compares, which no size in bytes tells: the parts stay as many as they are,
    # and neither side is sent whole to all.
    sides = [
        _dealt(side, heavy, deal, row).repartition(parts, *key)
        for side, deal, row in ((placed, F.col("_by_points"), points.columns), (cover, ~F.col("_by_points"), rectangles.columns))
    ]
    met = sides[0].hint("merge").join(sides[1], key)
    return met.where("x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1").select(*points.columns, *rectangles.columns)
