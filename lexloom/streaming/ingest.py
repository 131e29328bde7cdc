"""Incremental ingestion: streams of node or edge rows are upserted batch by batch.

A table is kept in BUCKETS buckets by the hash of its key. A batch reads and
rewrites only the buckets that it touches, as a new version beside the old one; of
each bucket, readers take the newest version. Upserts are idempotent, so a batch
that is replayed after a failure writes the same rows again. Versions that neither
readers of the newest state nor a replay can need are deleted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.graph import upsert_nodes
from lexloom.operators.parse import NODE

BUCKETS = 64
NODE_KEYS, EDGE_KEYS = ("label", "uid"), ("src", "dst", "rel_type")
EDGES = "src string, dst string, rel_type string, new_text string, old_text string, effective_date date, ord long"


def node_stream(spark: SparkSession, path: str, schema: str = NODE) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def edge_stream(spark: SparkSession, path: str, schema: str = EDGES) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def upsert_into(stream: DataFrame, table_dir: str, checkpoint: str, keys: Sequence[str] = NODE_KEYS) -> StreamingQuery:
    """Keeps ``table_dir/v=<batch>/bucket=<b>`` current; a later non-null property wins."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        touched = {r["bucket"] for r in placed.select("bucket").distinct().collect()}  # at most BUCKETS
        if not touched:
            return
        old = current(spark, table_dir, before=epoch, buckets=touched)
        merged = upsert_nodes(batch.limit(0) if old is None else old.select(columns), batch, keys)
        merged.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table_dir}/v={epoch}")
        _forget(spark, table_dir, epoch)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, table_dir: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(table_dir)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, table_dir: str) -> dict[int, list[int]]:
    """Versions of each bucket that were written whole, oldest first."""
    where, fs = _files(spark, table_dir)
    path, out = spark._jvm.org.apache.hadoop.fs.Path, {}
    for v in sorted(int(f.getPath().getName()[2:]) for f in fs.listStatus(where) if f.getPath().getName().startswith("v=")) if fs.exists(where) else []:
        if fs.exists(path(f"{table_dir}/v={v}/_SUCCESS")):
            for f in fs.listStatus(path(f"{table_dir}/v={v}")):
                if f.getPath().getName().startswith("bucket="):
                    out.setdefault(int(f.getPath().getName()[7:]), []).append(v)
    return out


def current(spark: SparkSession, table_dir: str, before: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
    """The newest rows, or the newest before a batch; of the given buckets, or of all."""
    newest = {b: [v for v in vs if before is None or v < before][-1:] for b, vs in _versions(spark, table_dir).items() if buckets is None or b in buckets}
    paths = [f"{table_dir}/v={v[0]}/bucket={b}" for b, v in sorted(newest.items()) if v]
    return spark.read.parquet(*paths) if paths else None


def _forget(spark: SparkSession, table_dir: str, epoch: int) -> None:
    """Deletes versions of buckets that have two newer ones."""
    _, fs = _files(spark, table_dir)
    for b, vs in _versions(spark, table_dir).items():
        for v in vs[:-2]:
            if v < epoch:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{table_dir}/v={v}/bucket={b}"), True)
