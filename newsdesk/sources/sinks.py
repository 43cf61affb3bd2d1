"""Writers of reports, archives, manifests and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_markdown(reports: DataFrame, path: str) -> None:
    """One text document per report: reports (report_id, markdown_text), in a folder of each report."""
    reports.select("report_id", F.col("markdown_text").alias("value")).write.mode("overwrite").partitionBy("report_id").text(path)


def report_json(items: DataFrame) -> DataFrame:
    """(report_date, value): flat items as one nested JSON object per report: sections of themes of sorted items."""
    item = F.struct("published_at", "title", *(c for c in items.columns if c not in ("report_date", "category", "theme", "published_at", "title")))
    groups = items.groupBy("report_date", "category", "theme").agg(F.array_sort(F.collect_list(item)).alias("items"))
    sections = groups.groupBy("report_date", "category").agg(F.array_sort(F.collect_list(F.struct(F.col("theme").alias("title"), "items"))).alias("groups"))
    order = F.when(F.col("category") == "technology", 0).when(F.col("category") == "industry", 1).otherwise(2)
    nested = sections.groupBy("report_date").agg(F.array_sort(F.collect_list(F.struct(order.alias("place"), F.col("category").alias("key"), "groups"))).alias("sections"))
    return nested.select("report_date", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "report_date", "sections")).alias("value"))


def write_report_json(items: DataFrame, path: str) -> None:
    report_json(items).write.mode("overwrite").partitionBy("report_date").text(path)


def archive_contents(contents: DataFrame, cache: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, contents): the cached body of the named contents, else title, summary and address; they are marked
    as archived in full."""
    wanted = ids.select("content_id").distinct().withColumn("_wanted", F.lit(True))
    body = contents.join(wanted, "content_id", "left_semi").join(cache.select("content_id", "clean_text"), "content_id", "left")
    text = F.coalesce(F.nullif(F.col("clean_text"), F.lit("")), F.concat_ws("\n\n", "title", F.coalesce("summary", F.lit("")), "url"))
    marked = contents.join(wanted, "content_id", "left").withColumn("extraction_status", F.when(F.col("_wanted"), "archived").otherwise(F.col("extraction_status"))).withColumn("full_content_saved", F.coalesce("_wanted", F.lit(False))).drop("_wanted")
    return body.select("content_id", text.alias("value")), marked


def append_manifest(manifests: DataFrame, path: str) -> None:
    """Append run manifests (run_id, target_date, status, counts, warnings, artifacts, ...)."""
    manifests.write.mode("append").parquet(path)


def snapshot_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def verify_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> DataFrame:
    """(table, rows, ok): each copy against its source by count and by a sum of row hashes that no order changes."""

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first())

    rows = []
    for name, df in tables.items():
        a, b = digest(df), digest(spark.read.schema(df.schema).parquet(f"{path}/{name}"))
        rows.append((name, a[0], a == b))
    return spark.createDataFrame(rows, "table string, rows long, ok boolean")
