"""Streams of nodes and edges in any order: an edge is stored once both its ends are.

One query reads both kinds, so batches have one order. Besides the nodes and edges,
a graph's folder holds the uids that have come, and the edges that wait, by hash of the
end they wait for: a batch looks up only buckets of its own uids, of its edges' ends,
and of the edges that it wakes. An edge whose two ends are missing waits for its
source, then for its target. All tables are versions by bucket (see ``ingest``), read
as they were before the batch, so a replayed batch writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.graph import last_property_wins, upsert_nodes
from lexloom.streaming.ingest import BUCKETS, EDGE_KEYS, NODE_KEYS, _forget, current

WAITS = "waits_for"


def both(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One stream of the two: node and edge structs, one of which is null."""
    node, edge = F.struct(*nodes.columns), F.struct(*edges.columns)
    a = nodes.select(node.alias("node"), F.lit(None).cast(edges.select(edge.alias("e")).schema["e"].dataType).alias("edge"))
    b = edges.select(F.lit(None).cast(nodes.select(node.alias("n")).schema["n"].dataType).alias("node"), edge.alias("edge"))
    return a.unionByName(b)


def _bucket(*keys: str):
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _touched(df: DataFrame, *ends: str) -> set[int]:
    return {r[0] for r in df.select(F.explode(F.array(*[_bucket(e) for e in ends]))).distinct().collect()}  # at most BUCKETS


class LinkedGraph:
    """Tables of one graph under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame | None:
        """nodes, edges, uids or waiting as they are now; None if there are none yet."""
        return self._at(self.spark, name)

    def _at(self, spark: SparkSession, name: str, before: int | None = None, buckets: set[int] | None = None) -> DataFrame | None:
        found = current(spark, f"{self.root}/{name}", before, buckets)
        return found.where(f"{WAITS} is not null") if found is not None and name == "waiting" else found

    def _put(self, rows: DataFrame, name: str, epoch: int, keys: tuple[str, ...]) -> None:
        rows.withColumn("bucket", _bucket(*keys)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/v={epoch}")
        _forget(rows.sparkSession, f"{self.root}/{name}", epoch)

    def _merge(self, rows: DataFrame, name: str, epoch: int, keys: tuple[str, ...]) -> None:
        """Upserts rows into the buckets that they fall in."""
        buckets = {r[0] for r in rows.select(_bucket(*keys)).distinct().collect()}
        if buckets:
            old = self._at(rows.sparkSession, name, epoch, buckets)
            self._put(upsert_nodes(rows.limit(0) if old is None else old.select(rows.columns), rows, keys), name, epoch, keys)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        nodes, edges = batch.where("node is not null").select("node.*"), batch.where("edge is not null").select("edge.*")
        columns = edges.columns
        uids = nodes.select("uid").distinct().withColumn("ord", F.lit(0))
        self._merge(nodes, "nodes", epoch, NODE_KEYS)
        self._merge(uids, "uids", epoch, ("uid",))
        # edges that wait for a uid of this batch wake up; the others of their buckets stay
        new = _touched(uids, "uid")
        held = self._at(spark, "waiting", epoch, new)
        woken = edges.limit(0) if held is None else held.join(uids.select(F.col("uid").alias(WAITS)), WAITS, "left_semi").select(columns)
        asked = last_property_wins(edges.unionByName(woken), EDGE_KEYS).select(columns).persist()
        known = self._at(spark, "uids", epoch + 1, _touched(asked, "src", "dst"))
        known = uids.select("uid") if known is None else known.select("uid")
        end = lambda c: known.select(F.col("uid").alias(c), F.lit(True).alias(f"_{c}"))
        placed = asked.join(end("src"), "src", "left").join(end("dst"), "dst", "left").withColumn(WAITS, F.when(F.col("_src").isNull(), F.col("src")).when(F.col("_dst").isNull(), F.col("dst")))
        self._merge(placed.where(f"{WAITS} is null").select(columns), "edges", epoch, EDGE_KEYS)
        waiting = placed.where(f"{WAITS} is not null").select(*columns, WAITS)
        touched = new | _touched(waiting, WAITS)
        if touched:
            held = self._at(spark, "waiting", epoch, touched)
            rest = waiting.limit(0) if held is None else held.join(uids.select(F.col("uid").alias(WAITS)), WAITS, "left_anti").select(waiting.columns)
            merged = upsert_nodes(rest, waiting, (*EDGE_KEYS, WAITS)).withColumn("bucket", _bucket(WAITS))
            # a bucket that becomes empty is written too, or its older version would stay the newest
            marks = spark.createDataFrame([(b,) for b in sorted(touched)], "bucket int")
            merged.unionByName(marks, allowMissingColumns=True).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/waiting/v={epoch}")
            _forget(spark, f"{self.root}/waiting", epoch)
        asked.unpersist()
        batch.unpersist()

    def follow(self, nodes: DataFrame, edges: DataFrame, checkpoint: str) -> StreamingQuery:
        """Keeps the graph current with the streams, as far as they are there."""
        return both(nodes, edges).writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
