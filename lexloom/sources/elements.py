"""Large element files: one JSON object with a root array ``kids``, read by many tasks.

Spark's text reader cuts a file at every closing brace, wherever its blocks begin. A
piece alone doesn't tell whether it lies in a string or how deep, but both are sums:
the quotes before it (an odd number: in a string), then the brackets outside strings.
Sums run inside a block and are shifted by what the blocks before it hold, a row a
block. An element of ``kids`` ends where a brace brings the depth back to that of the
array, so the pieces between two ends are one element, and only they come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.tables import materialize, release

#: Depth inside the root's array.
INSIDE = 2
KIDS = '"kids"\\s*:\\s*\\['


def _before(df: DataFrame, value: str, name: str) -> DataFrame:
    """df and the sum of ``value`` over all pieces of the file before each."""
    sums = df.groupBy("file", "block").agg(F.sum(value).alias("_s"))
    shift = sums.select("file", "block", F.coalesce(F.sum("_s").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))  # a row a block
    own = F.coalesce(F.sum(value).over(W.partitionBy("file", "block").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn(name, own).join(shift, ["file", "block"]).withColumn(name, F.col(name) + F.col("_shift")).drop("_shift")


def _bare(text: Column) -> Column:
    """The text without its strings; escapes must be gone, and it must not begin inside a string."""
    return F.regexp_replace(text, '"[^"]*("|$)', "")


def _balance(bare: Column) -> Column:
    count = lambda chars: F.length(bare) - F.length(F.translate(bare, chars, ""))
    return count("[{") - count("]}")


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(source_pdf, at, element): the objects of each file's root array, in order; a file without ``kids`` is an error.

    Elements must be objects; an empty array gives no rows.
    """
    read = spark.read.option("lineSep", "}").text(path)
    pieces = read.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    plain = F.regexp_replace("value", r"\\.", "")
    base = materialize(pieces.withColumn("quotes", F.length(plain) - F.length(F.translate(plain, '"', ""))), "element-pieces")
    quoted = _before(base, "quotes", "q").withColumn("inside", F.col("q") % 2 == 1).withColumn("ends_inside", (F.col("q") + F.col("quotes")) % 2 == 1)
    bare = _bare(F.concat(F.when(F.col("inside"), '"').otherwise(""), F.regexp_replace("value", r"\\.", "")))
    measured = quoted.select("file", "block", "id", "value", "ends_inside", bare.alias("bare")).withColumn("delta", _balance(F.col("bare")) - F.when(F.col("ends_inside"), 0).otherwise(1))
    deep = materialize(_before(measured, "delta", "depth"), "element-depths")
    release(base)
    # where the array begins: at the root's own level; and where it ends: the first closing bracket at its level
    lead = F.regexp_extract("value", f"(?s)^(.*?){KIDS}", 1)
    opens = (F.col("depth") < INSIDE) & F.col("value").rlike(f"(?s){KIDS}") & (F.col("depth") + _balance(_bare(F.regexp_replace(lead, r"\\.", ""))) == 1)
    place = F.struct("block", "id")
    after = F.regexp_replace("value", f"(?s)^.*?{KIDS}", "")
    closes = F.when(opens, after).otherwise(F.col("bare")).rlike(r"^\s*\]") & (opens | (F.col("depth") == INSIDE))
    bounds = deep.groupBy("file").agg(F.min(F.when(opens, place)).alias("first"), F.array_sort(F.collect_list(F.when(closes, place))).alias("last"))
    bounds = bounds.withColumn("last", F.filter("last", lambda x: x >= F.col("first"))[0]).withColumn("first", F.when(F.col("first").isNull(), F.raise_error(F.concat(F.lit("no kids in "), "file"))).otherwise(F.col("first")))
    within = deep.join(bounds, "file").where((place >= F.col("first")) & (F.col("last").isNull() | (place < F.col("last"))))
    ends = ~F.col("ends_inside") & (F.col("depth") + F.col("delta") == INSIDE)
    text = F.concat(F.when(place == F.col("first"), after).otherwise(F.col("value")), F.lit("}"))
    numbered = materialize(_before(within.select("file", "block", "id", text.alias("text"), ends.cast("int").alias("ends")), "ends", "at"), "element-texts")
    release(deep)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "id", "text"))), lambda x: x["text"]), "")
    whole = numbered.groupBy("file", "at").agg(joined.alias("element"), F.max("ends").alias("ends")).where("ends = 1")
    return whole.select(F.regexp_extract("file", r"^(.*?)(?:\.json)?$", 1).alias("source_pdf"), "at", F.regexp_replace("element", r"^[\s,]+", "").alias("element"))
