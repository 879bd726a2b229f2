"""Bucketed catalog tables, and marts refreshed by changed buckets."""

import uuid

import pytest
from pyspark.sql import functions as F

from larder.plans import refresh as R
from larder.plans.marts import food_mart, price_mart
from larder.plans.vocabulary import PRICE_COLUMNS
from larder.sources import catalog as C
from workload import inputs as I
from workload.stored import _shared_inputs, _yesterday, price_mart_refresh

FOLDER = "/root/testdata/sf0.001"


def name():
    return f"t{uuid.uuid4().hex}"


def saved(spark, tmp_path, rows, schema, buckets=8, **more):
    table = name()
    C.save_bucketed(spark.createDataFrame(rows, schema), table, "code", buckets, str(tmp_path / table), **more)
    return table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_join_of_buckets_moves_nothing(spark, tmp_path, no_broadcast):
    offers = [(k % 50, k) for k in range(500)]
    a = saved(spark, tmp_path, offers, "code long, offer int")
    b = saved(spark, tmp_path, [(k, f"p{k}") for k in range(40)], "code long, product string")
    joined = C.join_bucketed(spark, a, b, "code")
    assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert sorted(map(tuple, joined.collect())) == sorted((k, o, f"p{k}") for k, o in offers if k < 40)
    assert "Exchange" in plan(spark.table(a).join(spark.table(b).withColumnRenamed("code", "c"), F.col("c") + 1 == F.col("code")))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_and_missing_keys(spark, tmp_path, no_broadcast, how):
    """A third of all rows with one key, NULL keys, and hot keys on either side; the join is the usual one."""
    offers = [("hot", k) for k in range(400)] + [(None, k) for k in range(400, 700)] + [(f"c{k % 90}", k) for k in range(700, 1200)]
    products = [(f"c{k}", k) for k in range(0, 120, 2)] + [("hot", 1), (None, 5)] + [("c4", k) for k in range(1000, 1060)]
    a = saved(spark, tmp_path, offers, "code string, offer int", 16)
    b = saved(spark, tmp_path, products, "code string, product int", 16)
    assert set(C.stored_hot_keys(spark, a)) >= {"hot"} and C.stored_hot_keys(spark, b) == ["c4"]
    plain_a, plain_b = spark.createDataFrame(offers, "code string, offer int"), spark.createDataFrame(products, "code string, product int")
    assert sorted(C.read_table(spark, a).collect(), key=str) == sorted(plain_a.collect(), key=str)
    got, want = C.join_bucketed(spark, a, b, "code", how), plain_a.join(plain_b, "code", how)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    # The hot key's rows are in no bucket.
    assert spark.table(a).where("code = 'hot'").count() == 0


def test_comments_are_read_back(spark, tmp_path):
    table = saved(spark, tmp_path, [(1, "x")], "code long, text string", comment="Bob's \\ table", comments={"text": "It's text"})
    assert C.table_comment(spark, table) == "Bob's \\ table"
    assert [tuple(r) for r in C.column_comments(spark, table).orderBy("column").collect()] == [("code", "bigint", ""), ("text", "string", "It's text")]


def test_saving_again_replaces_both_parts(spark, tmp_path):
    table = name()
    hot = spark.createDataFrame([(1, k) for k in range(100)] + [(k, k) for k in range(2, 30)], "code long, v int")
    C.save_bucketed(hot, table, "code", 16, str(tmp_path / "a"))
    assert C.stored_hot_keys(spark, table) == [1]
    C.save_bucketed(spark.createDataFrame([(5, 5), (6, 6)], "code long, v int"), table, "code", 2, str(tmp_path / "b"))
    assert sorted(map(tuple, C.read_table(spark, table).collect())) == [(5, 5), (6, 6)]
    with pytest.raises(ValueError):
        C.join_bucketed(spark, table, table, "code", "full")


def test_empty_table(spark, tmp_path):
    table = saved(spark, tmp_path, [], "code long, v int")
    assert C.read_table(spark, table).collect() == [] and C.join_bucketed(spark, table, table, "code", "left_semi").collect() == []


def files_of(folder):
    return {str(f.relative_to(folder)) for f in folder.rglob("*.parquet")}


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_only_changed_buckets_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(k, k * 10) for k in range(200)] + [(None, 1)], "key long, v long")
    store = R.Store(spark, str(tmp_path / "copy"), 16)
    first = R.mirror(store, rows, "key")
    assert first.buckets == list(range(16)) and rows_of(first.table) == rows_of(rows)
    before = files_of(tmp_path / "copy/rows")
    assert R.mirror(store, rows.repartition(3), "key").buckets == []  # order and files of the input don't matter
    assert files_of(tmp_path / "copy/rows") == before
    now = rows.withColumn("v", F.when(F.col("key") == 77, F.lit(None)).otherwise(F.col("v")))
    second = R.mirror(store, now, "key")
    touched = rows.where("key = 77").select(R.bucket_of("key", 16)).first()[0]
    assert second.buckets == [touched] and rows_of(second.table) == rows_of(now)
    after = files_of(tmp_path / "copy/rows")
    own = f"{R.BUCKET}={touched}/"
    assert {f for f in after if not f.startswith(own)} == {f for f in before if not f.startswith(own)}
    assert {f for f in after if f.startswith(own)}.isdisjoint(before)


def test_emptied_buckets_go_and_new_ones_come(spark, tmp_path):
    rows = spark.createDataFrame([(k, k) for k in range(40)], "key long, v long")
    store = R.Store(spark, str(tmp_path / "copy"), 8)
    R.mirror(store, rows, "key")
    few = rows.where("key = 3")
    assert rows_of(R.mirror(store, few, "key").table) == rows_of(few)
    assert len(list((tmp_path / "copy/rows").glob(f"{R.BUCKET}=*"))) == 1
    none = rows.where("false")
    assert R.mirror(store, none, "key").table.collect() == []
    assert rows_of(R.mirror(store, rows, "key").table) == rows_of(rows)


def test_an_interrupted_refresh_is_done_again(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(k, k) for k in range(40)], "key long, v long")
    store = R.Store(spark, str(tmp_path / "copy"), 8)
    R.mirror(store, rows, "key")
    now = rows.withColumn("v", F.when(F.col("key") == 5, F.lit(-1)).otherwise(F.col("v")))
    with monkeypatch.context() as patch:
        patch.setattr(R.Store, "commit", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            R.mirror(store, now, "key")
    again = R.mirror(store, now, "key")
    assert len(again.buckets) == 1 and rows_of(again.table) == rows_of(now)
    assert R.mirror(store, now, "key").buckets == []


def test_digests_see_changes_that_keep_counts(spark):
    rows = spark.createDataFrame([(1, "a", [1]), (1, "b", [2])], "key long, s string, l array<int>")
    swapped = spark.createDataFrame([(1, "a", [2]), (1, "b", [1])], "key long, s string, l array<int>")
    twice = rows.unionByName(rows)
    own = R.digests(rows, "t", "key", 4)
    assert R.changed(own, R.digests(rows.repartition(2), "t", "key", 4)) == []
    for other in (swapped, twice, rows.where("false")):
        assert len(R.changed(own, R.digests(other, "t", "key", 4))) == 1


def test_price_mart_is_refreshed(spark, tmp_path):
    """Yesterday's mart brought up to date equals today's; a new rate touches all buckets."""
    columns = {old: new for old, new in PRICE_COLUMNS.items() if old in I.PRICE_COLUMNS}
    today = I.prices(spark, FOLDER), I.products(spark, FOLDER)
    others = _shared_inputs(spark, FOLDER)
    store = R.Store(spark, str(tmp_path / "mart"), 32)

    def bring(prices, products, rates):
        return R.refresh_price_mart(store, prices, products, I.NUTRIENTS, I.IDS, columns, rates=rates, **others)

    rates = I.rates(spark, FOLDER)
    bring(*_yesterday(*today), rates)
    before = files_of(tmp_path / "mart/rows")
    got = bring(*today, rates)
    whole = price_mart(*today, rates, nutrients=I.NUTRIENTS, nutrient_ids=I.IDS, price_columns=columns, **others)
    assert 0 < len(got.buckets) < 32 and rows_of(got.table) == rows_of(whole)
    kept = {f for f in before if int(f.split("=")[1].split("/")[0]) not in got.buckets}
    assert kept and kept <= files_of(tmp_path / "mart/rows")
    assert bring(*today, rates).buckets == []
    dearer = rates.withColumn("rate", F.col("rate") * 2)
    assert bring(*today, dearer).buckets == list(range(32))


def test_food_mart_is_refreshed_through_its_offers(spark, tmp_path):
    today = I.prices(spark, FOLDER), I.products(spark, FOLDER)
    others = _shared_inputs(spark, FOLDER)
    others["calnut_0"] = others["calnut_1"].select("ALIM_CODE").distinct()
    stores = R.Store(spark, str(tmp_path / "offers"), 32), R.Store(spark, str(tmp_path / "foods"), 32)
    rates = I.rates(spark, FOLDER)
    one_price = today[0].withColumn("price", F.when(F.col("id") == today[0].where("price is not null").agg(F.min("id")).first()[0], F.lit(1.0)).otherwise(F.col("price")))
    for prices in (one_price, today[0]):
        got = R.refresh_food_mart(*stores, prices, today[1], rates, I.NUTRIENTS, I.IDS, **others)
    assert len(got.buckets) <= 1
    whole = food_mart(*today, rates, nutrients=I.NUTRIENTS, nutrient_ids=I.IDS, **others)
    assert rows_of(got.table) == rows_of(whole)


def test_refreshed_mart_puts_prices_together_once(spark, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), I.prices

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    monkeypatch.setattr(I, "prices", lambda *given: plain(*given).mapInPandas(counted, plain(*given).schema))
    price_mart_refresh(spark, FOLDER)
    assert seen.value == plain(spark, FOLDER).count()


def test_digest_is_the_sum_of_row_hashes(spark):
    """Exactly, so that folders of earlier versions stay fresh."""
    rows = spark.range(5000).selectExpr("id AS key", "id * id AS v")
    got = {r.bucket: (r.rows, r.digest) for r in R.digests(rows, "t", "key", 4).collect()}
    summed = rows.groupBy(R.bucket_of("key", 4).alias("b")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("key", "v").cast("decimal(38,0)")).alias("d"))
    assert got == {r.b: (r.n, r.d) for r in summed.collect()}
