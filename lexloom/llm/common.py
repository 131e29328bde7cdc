"""What several operators of this folder share: tables in the shared folder,
word splitting, folds of documents, and distributed connected components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import workers_import
from lexloom.tables import materialize, release, shared_dir

__all__ = ["materialize", "release", "shared_dir"]

#: White space that ends a word: blank and the controls 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]+"
#: Rows of numbers that are broadcast at most.
FEW = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches handed to Python by rows, so that long texts fit; workers can import us."""
    workers_import(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it: the optimizer can't copy it into ``body``."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def byte_words(text: str | None) -> list[bytes]:
    """The same words of one text, with A-Z lower-cased, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` touch ASCII alone, which is the rule here.
    """
    return text.encode("utf-8", "replace").lower().split() if text else []


def are_stars(edges: DataFrame) -> tuple[bool, int]:
    """Whether each node of the edges (a > b) is a leaf of one node or a centre, not both; and the number of nodes."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("up")), F.struct(F.col("b").alias("node"), F.lit(None).alias("up")))).alias("e")).select("e.*")
    of = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.count_if(F.col("up").isNull()).alias("leaves"))
    more, nodes = of.agg(F.count_if(F.expr("low <> high or (low is not null and leaves > 0)")), F.count("*")).first()
    return more == 0, nodes


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of an edge: root is the least node reachable; a table, to be released.

    ``edges`` has columns a and b of one orderable type; direction, loops and
    repeats don't matter. Alternating large-star and small-star rounds: each
    round is two minimum aggregations (combined map-side) and two equi-joins,
    whose one side has a row per node, so a hub's edges can be split by AQE; up to
    FEW nodes, if they are numbers, that side is broadcast. The table of each round is
    written to the shared folder. Rounds go on until all components are stars, which
    is their fixed point; their number grows with the logarithm of the nodes.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(e, name)
    narrow = all(kind in ("bigint", "int") for _, kind in current.dtypes)
    done, nodes = are_stars(current)
    while not done:
        few = narrow and nodes <= FEW
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(F.broadcast(least) if few else least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large if few else large.distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(F.broadcast(lowest) if few else lowest, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = materialize(small.coalesce(edges.sparkSession.sparkContext.defaultParallelism) if few else small, name)
        release(current)
        current = after
        done, nodes = are_stars(current)
    centres = current.select("b").distinct()
    out = materialize(current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(centres.select(F.col("b").alias("node"), F.col("b").alias("root"))), f"{name}-roots")
    release(current)
    return out


def reading(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, marked as one that reads these tables until it is written."""
    df._lexloom_reads = tables
    return df


def release_read(df: DataFrame) -> None:
    """Delete the tables that ``df`` was marked to read, once it is written."""
    for used in getattr(df, "_lexloom_reads", ()):
        release(used)
