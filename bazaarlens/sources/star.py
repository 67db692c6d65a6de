"""Sources, sinks, samples and splits."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.functions.columns import as_col, md5_mod
from bazaarlens.operators.core import share_of_all
from bazaarlens.schemas import RANKED_LIST, STAR
from bazaarlens.session import durable


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns and types; a missing column becomes NULL."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def read_star(spark: SparkSession, folder: str, tables: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The star's parquet folders, conformed; fails when a required folder is missing."""
    wanted = list(tables or STAR)
    base = folder.rstrip("/")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    missing = [t for t in wanted if not fs_path(f"{base}/{t}").getFileSystem(conf).exists(fs_path(f"{base}/{t}"))]
    if missing:
        raise FileNotFoundError(f"missing tables under {base}: {missing}")
    return {t: conform(spark.read.parquet(f"{base}/{t}"), STAR[t]) for t in wanted}


def filtered_scan(
    df: DataFrame, columns: Sequence[str], date_column: str | None = None, start=None, end=None, event_types=None
) -> DataFrame:
    """Projection with date and type predicates; both reach the parquet reader."""
    out = df
    if date_column and start is not None:
        out = out.filter(F.col(date_column) >= F.lit(start).cast("date"))
    if date_column and end is not None:
        out = out.filter(F.col(date_column) <= F.lit(end).cast("date"))
    if event_types is not None:
        out = out.filter(F.col("event_type").isin(list(event_types)))
    return out.select(*columns)


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system, so that any store Spark reaches will do."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def input_files(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path as ``_metadata.file_path`` has it, length, time) of every file behind ``df``, sorted."""
    spark, out = df.sparkSession, []
    for name in df.inputFiles():  # encoded as URIs
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        out.append((path.toString(), status.getLen(), status.getModificationTime()))
    return sorted(out)


def stage_signature(df: DataFrame) -> str:
    """What a stage is made of: its input files with lengths and times, and its plan without Spark's running numbers."""
    plan = re.sub(r"#\d+L?|plan_id=\d+", "", df._jdf.queryExecution().analyzed().toString())
    return hashlib.sha256(json.dumps([input_files(df), plan, df.schema.json()]).encode()).hexdigest()


def stage_write(df: DataFrame, path: str, partition_by: Sequence[str] = (), overwrite: bool = False) -> tuple[DataFrame, str]:
    """Write one stage as ZSTD parquet unless the same one is there already; returns the table and the status.

    A finished write leaves ``_SUCCESS`` and then a manifest of the stage's inputs and plan. A
    half-written folder, changed input files or another plan are written again.
    """
    spark = df.sparkSession
    base = path.rstrip("/")
    done, fs = _path(spark, f"{base}/_SUCCESS")
    manifest, _ = _path(spark, f"{base}/_manifest")
    signature = stage_signature(df.select(*partition_by, *[c for c in df.columns if c not in partition_by]))
    known = None
    if fs.exists(done) and fs.exists(manifest):
        stream = fs.open(manifest)
        known = bytes(stream.readAllBytes()).decode()
        stream.close()
    status = "kept"
    if overwrite or known != signature:
        if fs.exists(manifest):
            fs.delete(manifest, False)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        stream = fs.create(manifest, True)
        stream.write(bytearray(signature.encode()))
        stream.close()
        status = "written"
    return spark.read.parquet(path), status


def read_ranked_list_csv(spark: SparkSession, path: str) -> DataFrame:
    """A ranked list with header; the rank is an integer and required columns must be present."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    lacking = {"user_id", "rank", "item_id"} - set(raw.columns)
    if lacking:
        raise ValueError(f"ranked list lacks columns {sorted(lacking)}")
    return conform(raw, RANKED_LIST)


def global_row_number(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """1..n over the whole table in ``order`` without a one-task window.

    Rows are range-partitioned, written once with their partition number (so the numbering is fixed
    even when executors are lost), numbered inside each partition and shifted by the partition
    totals, one row per partition.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__part", F.spark_partition_id())
    kept = durable(ranged, "ranged")
    totals = kept.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    shift = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    local = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return (
        kept.withColumn("__local", local).join(shift, "__part")
        .withColumn(out, F.col("__local") + F.col("__shift")).drop("__part", "__local", "__shift")
    )


def write_ranked_list_csv(ranked: DataFrame, path: str) -> DataFrame:
    """Number the list by (user, rank), keep the column order, write UTF-8 CSV, return the rows."""
    numbered = global_row_number(ranked, ["user_id", "rank"], "ID").select("ID", "user_id", "rank", "item_id")
    numbered.sortWithinPartitions("ID").write.mode("overwrite").csv(path, header=True, encoding="UTF-8")
    return numbered


def align_to_template(predictions: DataFrame, template: DataFrame) -> DataFrame:
    """Predictions in the template's ID order; raises in the job if a slot is missing or doubled."""
    keyed = predictions.groupBy("user_id", "rank").agg(F.max("item_id").alias("item_id"), F.count("*").alias("__c"))
    joined = template.select("ID", "user_id", "rank").join(keyed, ["user_id", "rank"], "left")
    bad = F.col("__c").isNull() | (F.col("__c") > 1)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no single prediction for user "), F.col("user_id").cast("string"))))
    return joined.select("ID", "user_id", "rank", checked.otherwise(F.col("item_id")).alias("item_id"))


# ---- samples ------------------------------------------------------------------------------------

def block_sample(df: DataFrame, percent: float, seed: int = 7) -> DataFrame:
    """``percent`` of a table's bytes as whole files: only those are opened when the scan runs.

    Files are taken in the order of a seeded hash of their names until the next would be too much;
    of that one the missing share of rows is drawn. So totals are scaled by 100 / percent. A
    derived table has no files to choose from: its rows are drawn one by one.
    """
    if "_metadata" not in df._jdf.queryExecution().analyzed().metadataOutput().mkString(",") or percent >= 100:
        return df.sample(fraction=min(percent, 100) / 100.0, seed=seed)
    sizes = {name: length for name, length, _ in input_files(df)}
    left = sum(sizes.values()) * percent / 100.0
    whole: list[str] = []
    for name in sorted(sizes, key=lambda n: (zlib.crc32(f"{seed}:{n.rpartition('/')[2]}".encode()), n)):
        if sizes[name] > left:
            part, share = name, left / sizes[name]
            break
        whole.append(name)
        left -= sizes[name]
    else:
        part, share = None, 0.0
    at = F.col("_metadata.file_path")
    taken = df.filter(at.isin(whole + [part] if part else whole))
    return taken.filter(at.isin(whole) | (F.rand(seed) < F.lit(share))) if part else taken


def row_sample(df: DataFrame, fraction: float, seed: int = 7) -> DataFrame:
    return df.filter(F.rand(seed) < F.lit(fraction))


def hash_sample(df: DataFrame, key: Column | str, fraction: float) -> DataFrame:
    """All rows of a fraction of the keys: whole sessions stay together."""
    return df.filter(md5_mod(key, 1000) < int(fraction * 1000))


def scale_up(counts: DataFrame, value: str, fraction: float) -> DataFrame:
    """Estimated totals of a sample with their share."""
    estimate = F.bround(F.col(value) / F.lit(fraction), 0).cast("long")
    return share_of_all(counts.withColumn("estimate", estimate), "estimate", "share_pct", bounded=False)


def hash_split(df: DataFrame, key: Column | str, train_pct: int = 80, out: str = "is_train") -> DataFrame:
    return df.withColumn(out, F.when(md5_mod(key, 100) < train_pct, 1).otherwise(0))


def stratified_sample(df: DataFrame, by: str, n: int, seed: int = 7, key: str = "item_id") -> DataFrame:
    """``n`` random rows per stratum; a seeded hash of the key gives the order, so reruns agree."""
    w = W.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


# ---- splits -------------------------------------------------------------------------------------

def temporal_split(events: DataFrame, valid_start: str, valid_end: str) -> dict[str, DataFrame]:
    """Split positive events: train before the start, validation inside the window (both ends
    included), the users present in both, and their distinct truth pairs."""
    lo, hi = F.lit(valid_start).cast("date"), F.lit(valid_end).cast("date")
    train = events.filter(F.col("date") < lo)
    valid = events.filter((F.col("date") >= lo) & (F.col("date") <= hi))
    users = valid.select("user_id").distinct().join(train.select("user_id"), "user_id", "left_semi")
    truth = valid.join(users, "user_id", "left_semi").select("user_id", "item_id").distinct()
    return {"train": train, "valid": valid, "users": users, "truth": truth}


def walk_forward_folds(events: DataFrame, folds: Sequence[Mapping[str, str]]) -> DataFrame:
    """Every event once per fold it belongs to, labelled with fold and part."""
    rows = []
    for number, f in enumerate(folds, 1):
        d = F.col("date")
        part = F.when(d <= F.lit(f["train_end"]).cast("date"), "train").when(
            d.between(F.lit(f["valid_start"]).cast("date"), F.lit(f["valid_end"]).cast("date")), "valid")
        rows.append(F.struct(F.lit(number).alias("fold"), part.alias("part")))
    tagged = events.withColumn("__f", F.explode(F.array(*rows)))
    return tagged.select(*events.columns, "__f.fold", "__f.part").filter(F.col("part").isNotNull())


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)

