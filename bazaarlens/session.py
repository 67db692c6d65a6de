"""Session settings and durable stage tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

TUNED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators expect; sizes stay with the cluster."""
    builder = SparkSession.builder.appName("bazaarlens")
    if master:
        builder = builder.master(master)
    for key, value in {**TUNED, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's checkpoint folder, else one in the warehouse.

    A cluster whose only such folder is a warehouse on local disks has no shared folder: that raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith("file:"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse.rstrip('/')}/_stages"


def _removed_at_exit(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage.

    The copy outlives any executor, so a lost executor never recomputes the plan behind it. It is
    removed when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/bazaarlens/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _removed_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str, dealt: bool = False) -> DataFrame:
    """``durable``, dealt into buckets by ``keys``: joins and groups by them read it without an exchange.

    Buckets are as many as the session's shuffle partitions, so all stages of a session fit each
    other. ``dealt`` says that ``df`` comes from such a stage and is in its buckets already.
    """
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/bazaarlens/{table}"
    rows = df if dealt else df.repartition(n, *keys)
    rows.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    _removed_at_exit(spark, path)
    return spark.table(table)
