"""Flattening of element trees: one step of plain explodes for each level."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.tables import materialize, release

TEXTS, MARGINS = ("heading", "paragraph", "caption"), ("header", "footer")
#: What an element of a type opens; all others open their kids.
OPENED = {"list": '$["list items"]', "table row": "$.cells", "table": "$.rows"}
KIDS = "variant_get(v, '$.kids', 'array<variant>')"


def _level(parents: DataFrame, opened: str) -> DataFrame:
    """source_pdf, path, type and v of what each parent opens; a path sorts like the document."""
    path = F.concat("path", F.lpad(F.col("at").cast("string"), 7, "0"), F.lit("."))
    each = parents.selectExpr("source_pdf", "path", f"posexplode({opened}) as (at, v)")
    return each.select("source_pdf", path.alias("path"), F.expr("variant_get(v, '$.type', 'string')").alias("type"), "v")


def flatten_elements(raw: DataFrame) -> DataFrame:
    """(source_pdf, json), or (source_pdf, at, element) of ``sources.elements`` -> source_pdf, path, type, content, page in document order.

    ``json`` must have a root array ``kids``. Headings, paragraphs and captions
    are kept; page headers and footers go; list items, table rows and cells are
    opened, an element's own text before its parts. Levels follow each other until
    nothing is left to open, so neither depth nor number of elements is limited.
    """
    if "element" in raw.columns:
        top = raw.select("source_pdf", F.concat(F.lpad(F.col("at").cast("string"), 12, "0"), F.lit(".")).alias("path"), F.parse_json("element").alias("v"))
        level = materialize(top.select("source_pdf", "path", F.expr("variant_get(v, '$.type', 'string')").alias("type"), "v"), "elements")
    else:
        roots = raw.select("source_pdf", F.lit("").alias("path"), F.parse_json("json").alias("v"))
        level = materialize(_level(roots, f"coalesce({KIDS}, raise_error('root has no kids'))"), "elements")
    levels, cases = [level], " ".join(f"when '{t}' then coalesce(variant_get(v, '{p}', 'array<variant>'), {KIDS})" for t, p in OPENED.items())
    while not level.isEmpty():
        inner = level.where(~F.col("type").isin(*TEXTS, *MARGINS))
        level = materialize(_level(inner, f"case type {cases} else {KIDS} end"), "elements")
        levels.append(level)
    release(levels.pop())
    if not levels:
        levels = [level.where("false")]
    leaf = reduce(DataFrame.unionByName, levels).selectExpr("source_pdf", "path", "type", "variant_get(v, '$.content', 'string') as content", "variant_get(v, '$[\"page number\"]', 'int') as page", f"size({KIDS}) as parts")
    text = F.col("type").isin(*TEXTS)
    own = (F.coalesce("content", F.lit("")) != "") & ~F.col("type").isin(*MARGINS) & ((F.col("type") == "list item") | (F.col("parts") == 0))
    return leaf.where(text | own).select("source_pdf", "path", F.when(text, F.col("type")).otherwise("paragraph").alias("type"), "content", "page")
