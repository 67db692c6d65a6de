"""Spark helpers of the operators: document keys, bounded bitmaps, packed columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.session import durable
from bazaarlens.sources.star import global_row_number

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed(docs: DataFrame, *extra: str) -> tuple[DataFrame, int]:
    """(doc_id, text, extra columns, key) and a divisor: key // divisor orders documents as doc_id does.

    Where every doc_id is set and unique, the key is the doc_id and the divisor 1; this is counted
    over the whole id column. Otherwise all rows are numbered in the order of their ids, null ids last,
    in a written table; the divisor is the rows of the most frequent id, so that every row has a key
    of its own however many share an id.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)
    odd = plain.groupBy("doc_id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col("doc_id").isNull())
    if odd.isEmpty():
        return plain.withColumn("key", F.col("doc_id")), 1
    most, n = odd.agg(F.max("n")).first()[0], plain.count()
    if (n + 1) * most >= 1 << 63:
        raise ValueError(f"{n} rows, {most} of them with one doc_id, have no keys of 64 bits")
    order = {"none": F.col("doc_id").isNull(), "hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()}
    numbered = durable(global_row_number(plain.withColumns({f"_{k}": v for k, v in order.items()}), ["_none", "doc_id", "_hash", "_tie"], "_number"), "numbered")
    first = numbered.groupBy(F.col("doc_id").alias("_other")).agg(F.min("_number").alias("_first"))
    rows = numbered.join(first, F.col("doc_id").eqNullSafe(F.col("_other")))
    key = F.col("_first") * most + F.col("_number") - F.col("_first")
    return durable(rows.select("doc_id", "text", *extra, key.cast("long").alias("key")), "keyed"), most


def hashed_bit(column: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def bitmap(df: DataFrame, bit: Column, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits, set where ``bit`` points; its size never depends on the data."""
    rows = (
        df.select(bit.alias("b")).select((F.col("b") / 64).cast("long").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 64).cast("int")).alias("v"))
        .groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    )
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[rows.column("w").to_numpy()] = rows.column("v").to_numpy().view(np.uint64)
    return out


def has_bit(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, then zstd: small numbers and rising ids shrink well."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1)
    return zstandard.compress(np.ascontiguousarray(raw.T).tobytes(), 1)


def unpack(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).view(dtype).reshape(-1)


def buckets_of(spark: SparkSession) -> int:
    """Hash buckets of a shuffle whose groups are handled one at a time; follows the cluster's setting."""
    return max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)
