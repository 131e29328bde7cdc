"""What the readers of acts and of rules share: numbered lines, node rows, appended text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.tables import materialize

NODE = "uid string, label string, parent string, number string, title string, term string, node_label string, text string, page_number int, source_pdf string, proviso_type string, form_number string, associated_rule string, ref_text string, ord long"
KINDS = {f.split()[0]: f.split()[1] for f in NODE.split(", ")}
FIELDS = list(KINDS)
BLOCK = 200_000
BEFORE = (W.unboundedPreceding, -1)


def _with_text(elements: DataFrame) -> DataFrame:
    return elements.select("source_pdf", "path", "type", T.strip(F.coalesce("content", F.lit(""))).alias("text"), F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page")).where("text <> ''")


def numbered(elements: DataFrame) -> DataFrame:
    """elements (source_pdf, path, type, content, page) -> source_pdf, pos, type, text, page of those with text."""
    at = F.row_number().over(W.partitionBy("source_pdf").orderBy("path")).cast("long")
    return _with_text(elements).select("source_pdf", at.alias("pos"), "type", "text", "page")


def numbered_in_blocks(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines as of ``numbered`` with ``block``, a range of about ``BLOCK`` lines in order, and the table that they read.

    No task puts more than its ranges in order, however few the sources are.
    """
    rows = _with_text(elements)
    n = rows.count() // BLOCK + 1
    ranged = materialize(rows.repartitionByRange(n, "source_pdf", "path").withColumn("block", F.spark_partition_id()), "lines-ranged")
    sizes = ranged.groupBy("source_pdf", "block").agg(F.count("*").alias("n"))
    offsets = sizes.select("source_pdf", "block", F.coalesce(F.sum("n").over(W.partitionBy("source_pdf").orderBy("block").rowsBetween(*BEFORE)), F.lit(0)).alias("offset"))  # a row a block
    at = F.row_number().over(W.partitionBy("source_pdf", "block").orderBy("path"))
    local = ranged.repartition(n, "source_pdf", "block").withColumn("at", at)
    return of_blocks(local, offsets).select("source_pdf", (F.col("offset") + F.col("at")).alias("pos"), "type", "text", "page", "block"), ranged


def of_blocks(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with what was found for their source and block (a row each)."""
    given = found.withColumnsRenamed({"source_pdf": "_source", "block": "_block"})
    return rows.join(F.broadcast(given), (F.col("block") == F.col("_block")) & F.col("source_pdf").eqNullSafe(F.col("_source"))).drop("_source", "_block")


def with_latest(rows: DataFrame, **events: Column) -> DataFrame:
    """Rows with the last event of each name before them in their source: of their block, else of the blocks before it.

    Events are structs whose first field is the line's pos, so the last is the greatest.
    """
    keys = ["source_pdf", "block"]
    ends = materialize(rows.groupBy(*keys).agg(*[F.max(e).alias(f"_{k}") for k, e in events.items()]), "lines-ends")
    over = W.partitionBy("source_pdf").orderBy("block").rowsBetween(*BEFORE)
    carried = ends.select(*keys, *[F.max(f"_{k}").over(over).alias(f"_{k}") for k in events])  # a row a block
    near = W.partitionBy(*keys).orderBy("pos").rowsBetween(*BEFORE)
    local = rows.repartition(max(ends.count(), 1), *keys).select("*", *[F.max(e).over(near).alias(k) for k, e in events.items()])
    return of_blocks(local, carried).select(*rows.columns, *[F.coalesce(k, f"_{k}").alias(k) for k in events])


def group(text: str | Column, pattern: str, n: int = 1) -> Column:
    """A group of the pattern, null where it does not match or is empty."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def nodes(rows: DataFrame, label: str, **fields: Column | str) -> DataFrame:
    """Rows as nodes of one label; fields that aren't given are null, page and source come from the rows."""
    given = {"label": F.lit(label), "page_number": F.col("page"), "source_pdf": F.col("source_pdf"), "ref_text": fields.get("text", F.lit("")), **fields}
    return rows.select(*[(F.lit(None) if c not in given else given[c] if isinstance(given[c], Column) else F.col(given[c])).cast(k).alias(c) for c, k in KINDS.items()])


def appended(lines: DataFrame, target: Column) -> DataFrame:
    """source_pdf, at, more: the texts that go to each target, in order, joined by blanks."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    return lines.where(target.isNotNull()).groupBy("source_pdf", target.alias("at")).agg(joined.alias("more"))
