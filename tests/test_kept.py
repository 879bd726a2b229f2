"""Profiles that grow, counts while writing, file order, clean XML, page rows, cells, draws and bitmaps."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from larder.functions.geo import grid, morton
from larder.functions.numeric import counter_random
from larder.functions.objective import ObjectiveError, compile_objective
from larder.operators import regions
from larder.operators.aggregates import venn_bitmaps, venn_regions
from larder.operators.ordered import in_file_order
from larder.operators.profiles import ProfiledTable
from larder.operators.quality import Counted, Rule, check_rules, write_counted
from larder.operators.regions import Plane, covered, points_in_rectangles
from larder.sources import html, tables, xml
from larder.sources import schemas as S
from workload.kept import seeded_random


def table_of(spark, tmp_path, rows, schema="a long, b double, c string"):
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "table"))
    return ProfiledTable(spark, str(tmp_path / "table"), str(tmp_path / "states"), df.schema)


def profile_of(table):
    return {r.column_name: tuple(r)[1:] for r in table.profile().collect()}


def test_only_new_files_are_scanned(spark, tmp_path):
    table = table_of(spark, tmp_path, [(1, 2.0, "x"), (3, None, "y")])
    with pytest.raises(ValueError):
        table.profile()
    assert table.update() == 1 and table.update() == 0
    assert profile_of(table) == {"a": (2, 2, 1.0, 3.0, 2.0), "b": (2, 1, 2.0, 2.0, 2.0)}
    # What the old file holds is no longer looked at: it is not even readable.
    (old,) = (tmp_path / "table").glob("*.parquet")
    status = old.stat()
    old.write_bytes(b"?" * status.st_size)
    os.utime(old, ns=(status.st_atime_ns, status.st_mtime_ns))
    (tmp_path / "table" / f".{old.name}.crc").unlink(missing_ok=True)
    table = table_of(spark, tmp_path, [(-5, 7.5, "z")])
    assert table.update() == 1
    assert profile_of(table) == {"a": (3, 3, -5.0, 3.0, -1 / 3), "b": (3, 2, 2.0, 7.5, 4.75)}


def test_deleted_replaced_and_empty_files(spark, tmp_path):
    table = table_of(spark, tmp_path, [(1, 1.0, "")])
    table = table_of(spark, tmp_path, [(9, None, "")])
    table = table_of(spark, tmp_path, [])
    table.update()
    assert profile_of(table) == {"a": (2, 2, 1.0, 9.0, 5.0), "b": (2, 1, 1.0, 1.0, 1.0)}
    for file in (tmp_path / "table").glob("*.parquet"):
        if spark.read.parquet(str(file)).where("a = 9").count():
            file.unlink()
    assert profile_of(table) == {"a": (1, 1, 1.0, 1.0, 1.0), "b": (1, 1, 1.0, 1.0, 1.0)}


def test_counts_come_with_the_write(spark, tmp_path):
    rules = [Rule("positive", F.col("v") > 0), Rule("named", F.col("name") != "")]
    rows = spark.createDataFrame([(1, "a"), (-1, "b"), (None, ""), (5, None)], "v int, name string")
    counter = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    watched = rows.mapInArrow(seen, rows.schema)
    table, counts = write_counted(watched, rules, str(tmp_path / "t"), lambda df: df.where("v > 0").select("name"))
    assert sorted(map(tuple, counts.collect())) == [("named", 2, 4), ("positive", 2, 4)]
    assert sorted(map(str, table.collect())) == ["Row(name='a')", "Row(name=None)"]
    assert counter.value == 4  # one scan for the table and the counts
    broken = {r.rule: r["count"] for r in check_rules(rows, rules).groupBy("rule").count().collect()}
    assert broken == {"positive": 2, "named": 2}
    counted = Counted(rows.where("false"), rules)
    counted.rows.write.parquet(str(tmp_path / "none"))
    assert {tuple(r) for r in counted.counts().collect()} == {("positive", 0, 0), ("named", 0, 0)}


def test_load_rules_match_the_rejects(spark):
    rows = spark.createDataFrame([("1,5", "-", None), ("?", "traces", "2"), ("< 3", "x", "y")], "teneur string, min string, max string")
    rules = tables.readable_measures()
    assert check_rules(rows, rules).select("teneur").distinct().count() == tables.unreadable_measures(rows).count() == 2


def test_rows_keep_their_place_in_many_splits(spark, tmp_path):
    path = tmp_path / "text"
    path.mkdir()
    lines = [[f"{f},{k},{'x' * (k % 50)}" for k in range(700)] for f in range(3)]
    for f, content in enumerate(lines):
        (path / f"part-{f}.csv").write_text("f,k,t\n" + "\n".join(content) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        read = tables.read_csv(spark, str(path), spark.createDataFrame([], "f int, k int").schema)
        assert read.rdd.getNumPartitions() > 6
        got = in_file_order(read).orderBy("row_num").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.f, r.k, r.row_num) for r in got] == [(n // 700, n % 700, n + 1) for n in range(2100)]


def test_clean_xml_names_corrupt_records(spark, tmp_path):
    file = tmp_path / "a.xml"
    file.write_bytes('<?xml version="1.0" encoding="windows-1252"?>\n<TABLE><COMPO><a> café </a><b> &lt; 1 </b></COMPO>\n<COMPO><a/><b>2</b></COMPO></TABLE>'.encode("cp1252"))
    schema = S._text("a", "b")
    clean = xml.read_clean_xml_rows(spark, str(file), "COMPO", schema)
    assert [tuple(r) for r in clean.select("a", "b").collect()] == [("café", "< 1"), (None, "2")]
    assert [r._corrupt_record for r in clean.collect()] == [None, None]
    assert sorted(map(str, clean.drop("_corrupt_record").collect())) == sorted(map(str, xml.read_xml_rows(spark, str(file), "COMPO", schema).collect()))


def test_pages_with_very_many_rows(spark, monkeypatch):
    """Rows go out as they are parsed, whatever the pieces; pages without tables, empty and NULL ones give none."""
    page = "<tbody>" + "".join(f"<tr><td>{k}</td><th>n<sup>x</sup>{k}</th></tr>" for k in range(30_000)) + "</tbody>"
    pages = spark.createDataFrame([(1, page), (2, ""), (3, None), (4, "<p>none</p>"), (5, "<tbody><tr><td>open")], "page_id long, html string")
    got = html.extract_tables(pages, "page_id", "html")
    assert got.where("page_id = 1").agg(F.count("*"), F.sum("row_no"), F.max("table_no")).first() == (30_000, 30_000 * 29_999 // 2, 0)
    assert got.where("page_id = 1 and row_no = 777").first().cells == ["777", "n777"]
    assert {r.page_id for r in got.select("page_id").distinct().collect()} <= {1, 5}
    reader = html.table_reader()
    assert "Reader" in str(reader.func)


def test_points_in_rectangles_equal_comparison(spark):
    rnd = random.Random(6)
    points = [(k, rnd.uniform(-12, 12), rnd.uniform(-12, 12)) for k in range(400)] + [(900, 0.0, 0.0), (901, None, 1.0), (902, float("nan"), 0.0), (903, 10.0, 10.0)]
    rectangles = []
    for k in range(300):
        x, y, size = rnd.uniform(-12, 12), rnd.uniform(-12, 12), 10 ** rnd.uniform(-4, 1.3)
        rectangles.append((k, x, y, x + size * rnd.random(), y + size * rnd.random()))
    rectangles += [(1000, 0.0, 0.0, 0.0, 0.0), (1001, 5.0, 5.0, 4.0, 6.0), (1002, -99.0, -99.0, 99.0, 99.0), (1003, None, 0.0, 1.0, 1.0), (1004, 10.0, 10.0, 10.0, 10.0)]
    want = {(p, r) for (p, x, y), (r, x0, y0, x1, y1) in itertools.product(points, rectangles) if None not in (x, y, x0) and x0 <= x <= x1 and y0 <= y <= y1}
    a = spark.createDataFrame(points, "point long, x double, y double")
    b = spark.createDataFrame(rectangles, "rectangle long, x0 double, y0 double, x1 double, y1 double")
    met = points_in_rectangles(a, b, Plane(-10, -10, 10, 10))
    assert {(r.point, r.rectangle) for r in met.collect()} == want and met.count() == len(want)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert points_in_rectangles(a, b.where("false"), Plane(0, 0, 1, 1)).collect() == []


def test_long_rectangles_are_covered_by_cells_of_their_shape(spark):
    rows = [(1, 0.0, 0.0, 64.0, 0.5), (2, 3.0, 1.0, 3.5, 60.0), (3, 10.0, 10.0, 50.0, 50.0)]
    cells = covered(spark.createDataFrame(rows, "rectangle long, x0 double, y0 double, x1 double, y1 double"), Plane(0, 0, 100, 100)).collect()
    for key, x0, y0, x1, y1 in rows:
        own = [c for c in cells if c.rectangle == key]
        area = sum(2 ** (c.level_x + c.level_y) for c in own) * (100 / 65536) ** 2
        assert len(own) <= 25 and area <= 4 * (x1 - x0) * (y1 - y0)


def test_one_cell_of_many_pairs_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(regions, "PAIRS", 200)
    few, many = [(k, 5.0, 5.0) for k in range(40)], [(k, 5.0, 5.0) for k in range(300)]
    for points, around in ((few, many), (many, few)):
        a = spark.createDataFrame(points, "point long, x double, y double").coalesce(1)
        b = spark.createDataFrame([(k, x, y, x, y) for k, x, y in around], "rectangle long, x0 double, y0 double, x1 double, y1 double").coalesce(1)
        met = points_in_rectangles(a, b, Plane(0, 0, 10, 10)).select("point", "rectangle", F.spark_partition_id().alias("task")).collect()
        assert len(met) == len({(r.point, r.rectangle) for r in met}) == 12_000
        assert max(sum(r.task == t for r in met) for t in {r.task for r in met}) < 6_000


def test_seeded_lines_are_dealt_over_all_tasks(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("test tables are not here")
    before = {key: spark.conf.get(key) for key in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [r["count"] for r in seeded_random(spark, folder).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert max(rows) < sum(rows) / 10


def test_morton_codes_share_leading_bits(spark):
    cells = [(x, y) for x in (0, 1, 5, 65535) for y in (0, 2, 7, 65535)]
    rows = spark.createDataFrame(cells, "x long, y long").select("x", "y", morton(F.col("x"), F.col("y")).alias("m")).collect()
    for r in rows:
        assert r.m == sum(((r.x >> k) & 1) << 2 * k | ((r.y >> k) & 1) << 2 * k + 1 for k in range(16))
    edge = spark.createDataFrame([(-5.0,), (0.0,), (1.0,), (7.0,), (None,)], "v double").select(grid(F.col("v"), 0.0, 1.0)).collect()
    assert [r[0] for r in edge] == [0, 0, 65535, 65535, None]


def test_draws_depend_on_key_and_seed_only(spark):
    rows = spark.range(20_000).withColumn("x", F.col("id") * 1.0)

    def drawn(text, df, seed=3):
        return {r.id: r.d for r in df.select("id", compile_objective(text, rows.schema, F.col("id"), seed).alias("d")).collect()}

    one = drawn("random()", rows.repartition(2))
    assert one == drawn("random()", rows.repartition(7, "x")) != drawn("random()", rows, seed=4)
    values = list(one.values())
    assert all(0 <= v < 1 for v in values) and len(set(values)) > 19_900
    for k in range(10):
        assert 1800 < sum(k / 10 <= v < (k + 1) / 10 for v in values) < 2200
    two = drawn("random() - random()", rows)
    assert abs(sum(two.values()) / len(two)) < 0.01 and len({round(v, 6) for v in two.values()}) > 10_000
    mean = sum(values) / len(values)
    following = sum((one[k] - mean) * (one[k + 1] - mean) for k in range(19_999)) / 19_999
    assert abs(following) < 0.003  # neighbours are not correlated
    seeded = "greatest(0 * x, least(setseed(0.5), 1.0), random())"
    assert drawn(seeded, rows, 3) == drawn(seeded, rows, 99)
    with pytest.raises(ObjectiveError):
        compile_objective("setseed(x) + random()", rows.schema, F.col("id"))
    with pytest.raises(ObjectiveError):
        compile_objective("setseed(3) + random()", rows.schema, F.col("id"))
    odd = spark.createDataFrame([(-1,), (0,), (2**62,), (None,)], "k long").select(counter_random(F.col("k"), 5).alias("d")).collect()
    assert odd[3].d is None and all(0 <= r.d < 1 for r in odd[:3])


def test_bitmaps_count_regions_like_keys(spark):
    rnd = random.Random(9)
    sets = {}
    for n in ("a", "b", "c"):
        keys = [(rnd.randrange(100_000),) for _ in range(3000)] + [(None,), (32767,), (32768,), (0,)]
        sets[n] = spark.createDataFrame(keys, "key long").repartition(3)
    got = sorted(map(tuple, venn_bitmaps(sets, "key").select("a", "b", "c", "keys").collect()))
    assert got == sorted(map(tuple, venn_regions(sets, "key").select("a", "b", "c", "keys").collect()))
    assert sum(r[3] for r in got) == len({r.key for df in sets.values() for r in df.collect()} - {None})
    assert venn_bitmaps({n: df.where("false") for n, df in sets.items()}, "key").collect() == []


def test_a_catalog_without_a_needed_column_is_an_error(spark, tmp_path):
    spark.createDataFrame([("1",)], "code string").write.parquet(str(tmp_path / "products"))
    with pytest.raises(ValueError, match="nutriments"):
        tables.products(spark, str(tmp_path / "products"))
