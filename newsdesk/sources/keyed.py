"""Stored tables that are updated in place, bucket by bucket.

A table is a folder of Parquet files in folders of buckets, by a hash of its keys. An update reads the buckets that it
touches, writes what becomes of them beside the table, verifies that copy, and then overwrites these buckets alone; all
other buckets keep their files. Until the verified copy takes their place, the old files stay.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.operators.filters import purge_expired
from newsdesk.operators.joins import upsert

BUCKET = "bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create_keyed(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """Write rows as a new table."""
    _write(rows.withColumn(BUCKET, bucket_of(keys, buckets)), path, "error")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.repartition(BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def _touched(rows: DataFrame) -> list[int]:
    return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # as many as the table has buckets at most


def _swap(spark: SparkSession, new: DataFrame, path: str, keys: list[str], touched: list[int], expected: Column) -> dict:
    """Put `new` in place of the touched buckets. expected: how many rows there must be, from `n` and `keys` of the copy."""
    copy = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    _write(new, copy, "error")
    schema = new.schema
    held = spark.read.schema(schema).parquet(copy)
    found = held.agg(F.count(F.lit(1)).alias("n")).crossJoin(held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times")).agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.max("_times"), F.lit(0)).alias("most")))  # one row
    row = found.select("n", "keys", "most", expected.alias("ok")).first()
    if row["most"] > 1 or not row["ok"]:
        raise ValueError(f"the new buckets have {row['n']} rows of {row['keys']} keys, so the table was left as it is: {copy}")
    if row["n"]:
        _write(held, path, "overwrite")
    # what has no rows any more is not overwritten
    gone = set(touched) - set(_touched(held))
    for b in gone:
        _remove(spark, f"{path.rstrip('/')}/{BUCKET}={b}")
    _remove(spark, copy)
    return {"buckets": len(touched), "rows": row["n"]}


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever storage it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def upsert_keyed(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], columns: list[str], buckets: int, insert_only: list[str] = []) -> dict:  # noqa: B006
    """upsert() into a stored table. Rows of updates need one row a key; returns the buckets and rows that were written."""
    new = updates.withColumn(BUCKET, bucket_of(keys, buckets))
    touched = _touched(new)
    if not touched:
        return {"buckets": 0, "rows": 0}
    old = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
    merged = upsert(old.drop(BUCKET), updates, keys, columns, insert_only).withColumn(BUCKET, bucket_of(keys, buckets))
    inserted = updates.join(old, keys, "left_anti").count()
    return _swap(spark, merged, path, keys, touched, F.col("n") == old.count() + inserted)


def purge_keyed(spark: SparkSession, path: str, keys: list[str], ts: str, days: int, as_of: dt.datetime) -> dict:
    """purge_expired() in a stored table: only buckets with expired rows are written; returns these and the rows purged."""
    rows = spark.read.parquet(path)
    kept, purged = purge_expired(rows, ts, days, as_of)
    counts = {r[BUCKET]: r["n"] for r in purged.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {"buckets": 0, "rows": 0, "purged": 0}
    touched = sorted(counts)
    here = F.col(BUCKET).isin(touched)
    left = rows.where(here).count() - sum(counts.values())
    return _swap(spark, kept.where(here), path, keys, touched, F.col("n") == left) | {"purged": sum(counts.values())}
