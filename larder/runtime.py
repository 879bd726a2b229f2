"""Session settings, and the few places where a plan has to be cut or a size has to be known."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}


# Settings that suit these plans on any cluster. Adaptive execution is on by default; it splits
# hot partitions of shuffled joins, and here may also join by hash where both sides are even.
RECOMMENDED = {
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g", name: str = "larder") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where tests run on one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _scratch:
        _scratch[context.applicationId] = tempfile.mkdtemp(prefix="run-larder-")
    return _scratch[context.applicationId]


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back.

    Used where a non-deterministic value (a partition number) must be the same for
    every reader, or where an iteration would otherwise grow its lineage each round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a computation writes on its way, in the shared folder; close() deletes all but those kept."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[int, tuple[DataFrame, str]] = {}

    def table(self, df: DataFrame) -> DataFrame:
        """Write df and read it back, as materialize does."""
        path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(written)] = written, path
        return written

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            if found := self.tables.pop(id(table), None):
                path = self.spark._jvm.org.apache.hadoop.fs.Path(found[1])
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self, *kept: DataFrame) -> None:
        keep = {id(table) for table in kept}
        self.drop(*[table for key, (table, _) in self.tables.items() if key not in keep])
