"""Sources and sinks: raw element JSON, parsed tables, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_json(spark: SparkSession, path: str) -> DataFrame:
    """(source_pdf, json), one row a file; a file without a root array ``kids`` is an error when read."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.json)?$", 1).alias("source_pdf"), F.col("value").alias("json"))
    kids = F.try_variant_get(F.try_parse_json("json"), "$.kids", "array<variant>")
    return rows.withColumn("json", F.when(kids.isNotNull(), F.col("json")).otherwise(F.raise_error(F.concat(F.lit("no kids in "), "source_pdf"))))


def matching(raw: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """The first file, by name, whose stem holds one of the keywords."""
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(F.lower("source_pdf"), F.lit(k.lower()))
    return raw.where(found).orderBy("source_pdf").limit(1)


def parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed scan of parsed JSON; a row of another shape is an error, and so is a missing file: it tells which ones there are."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        folder = where.getParent()
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
        raise FileNotFoundError(f"{path} is not there; available: {', '.join(n for n in names if n.endswith('.json')) or 'none'}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Partitioned by label, so lookups of one label read its files alone."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(path)


def write_edges(edges: DataFrame, path: str) -> None:
    edges.write.mode("overwrite").partitionBy("rel_type").parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)  # a row
