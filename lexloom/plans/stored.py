"""A graph stored for hops without shuffles: buckets and order by the key of each join.

Nodes lie in buckets of their uids, edges twice: in buckets of their sources and of
their targets, as many each. A hop from nodes to edges, either way, joins bucket to
bucket, so a template moves what it has found so far, never the edges. Buckets can't
be split while they are read: an end whose largest bucket holds more than ``UNEVEN``
times its share (one act with a third of all edges) is stored without buckets, and
its joins are left to a shuffle that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.plans.templates import Graph

BUCKETS, UNEVEN, FEW = 64, 4, 10_000
SIDES = (("nodes", "uid"), ("edges_by_src", "src"), ("edges_by_dst", "dst"))


def even(df: DataFrame, key: str, buckets: int) -> bool:
    """Whether no bucket is far above the mean; small tables are."""
    sizes = df.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("b")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return found["most"] <= max(FEW, UNEVEN * found["n"] / buckets)


def store(graph: Graph, name: str, path: str, buckets: int = BUCKETS) -> Graph:
    """Writes the tables ``<name>_nodes``, ``<name>_edges_by_src`` and ``<name>_edges_by_dst`` under a shared path."""
    edges = graph.edges
    for side, key in SIDES:
        df = graph.nodes if side == "nodes" else edges
        if even(df, key, buckets):
            writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        else:
            writer = df.write
        writer.mode("overwrite").option("path", f"{path}/{side}").saveAsTable(f"{name}_{side}")
    return stored(graph.nodes.sparkSession, name)


def stored(spark: SparkSession, name: str) -> Graph:
    """The graph of these tables of the catalogue."""
    return Graph(*[spark.table(f"{name}_{side}") for side, _ in SIDES])
