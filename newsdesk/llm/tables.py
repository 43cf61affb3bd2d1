"""Reading the corpus tables, folders on shared storage, and samples by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdesk.sources.shared import shared_dir, stored


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/newsdesk-{name}-{uuid.uuid4().hex}"


def held_out(doc_id: Column) -> Column:
    """One document in five is never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def hash_share(key: Column, share: float) -> Column:
    """A fixed share of the keys, the same in every run and on every cluster."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def spare(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


__all__ = ["hash_share", "held_out", "new_path", "read", "shared_dir", "spare", "stored"]
