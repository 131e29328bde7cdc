"""Edges: structure, references, amendments and derived rules."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import parse
from lexloom.operators.graph import union_all
from lexloom.tables import materialize

EDGE = ["src", "dst", "rel_type", "new_text", "old_text", "effective_date", "seq"]
#: Edge type that leads to a node of each label.
CONTAINS = {"Chapter": "HAS_CHAPTER", "Section": "HAS_SECTION", "SubSection": "HAS_SUBSECTION", "Clause": "HAS_CLAUSE", "SubClause": "HAS_SUBCLAUSE", "Proviso": "HAS_PROVISO", "Explanation": "HAS_EXPLANATION", "Definition": "DEFINES", "Schedule": "HAS_SCHEDULE", "Rule": "HAS_RULE", "Form": "HAS_FORM"}
REFERENCE_TYPES = ("REFERS_TO", "SUBJECT_TO", "NOTWITHSTANDING", "IMPOSES_PENALTY", "PRESCRIBES_FOR", "DERIVED_RULE")
AMENDMENT_TYPES = ("SUBSTITUTES", "INSERTS", "OMITS", "DECRIMINALIZES")


def _edges(df: DataFrame, src: Column, dst: Column, rel: Column) -> DataFrame:
    empty = F.lit(None).cast("string")
    return df.select(src.alias("src"), dst.alias("dst"), rel.alias("rel_type"), empty.alias("new_text"), empty.alias("old_text"), F.lit(None).cast("date").alias("effective_date"), F.lit(0).cast("long").alias("seq"))


def contained(nodes: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """An edge from its parent to each node that has one, as often as the node is there."""
    of = {k: v for k, v in CONTAINS.items() if kinds is None or v in kinds}
    rel = F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("label"))
    return _edges(nodes.where(F.col("parent").isNotNull() & F.col("label").isin(list(of))), F.col("parent"), F.col("uid"), rel)


def structural_edges(nodes: DataFrame) -> DataFrame:
    return contained(nodes).distinct()


def _exploded(nodes: DataFrame, refs: Column) -> DataFrame:
    says = lambda c: F.lower(c).contains("section") | F.lower(c).contains("rule")  # noqa: E731  all phrases name one
    # texts pack so well that a split of a file holds very many: they are dealt out before patterns are tried
    dealt = nodes.where(says("ref_text") | says("text")).select("uid", "ref_text", "text").repartition("uid")
    # a plain explode would have Spark filter by the array, which it finds once more for that
    rows = dealt.select("uid", refs.alias("refs")).select("uid", F.explode_outer("refs").alias("r")).where(F.size("r.numbers") > 0)
    return rows.select("uid", "r.ref_type", F.explode_outer("r.numbers").alias("n"))


def references(nodes: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """uid, ref_type, n: each declared or detected reference to a section, as often as it is made."""
    return _exploded(nodes, parse.references_by_pattern(F.col("ref_text"), F.col("text"), kinds))


def _referred(nodes: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """Edges of references; of one node each once, so that only nodes of one uid can repeat them."""
    refs = parse.references_by_kind(F.col("ref_text"), F.col("text"), kinds)
    found = _exploded(nodes, refs).where(F.col("n").rlike("^[0-9]+$")).withColumn("dst", F.concat(F.lit("sec-"), "n"))
    return _edges(found, F.col("uid"), F.col("dst"), F.col("ref_type"))


def reference_edges(nodes: DataFrame) -> DataFrame:
    """Declared and detected references that resolve to a section, each (src, dst, type) once."""
    return _referred(nodes).distinct()


def derived(nodes: DataFrame) -> DataFrame:
    """Rule to section by the first phrase in its title, else in its text, and the map made by hand, as often as they are found."""
    rules = nodes.where("label = 'Rule'")
    n = F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), parse.DERIVED, 1), F.lit("")) for c in ("title", "text")])
    found = _edges(rules.where(n.isNotNull()), F.col("uid"), F.concat(F.lit("sec-"), n), F.lit("DERIVED_RULE"))
    by_hand = F.element_at(F.create_map(*[F.lit(x) for kv in parse.DERIVED_BY_HAND.items() for x in kv]), F.col("uid"))
    return found.unionByName(_edges(rules.where(by_hand.isNotNull()), F.col("uid"), by_hand, F.lit("DERIVED_RULE")))


def derived_rules(nodes: DataFrame) -> DataFrame:
    return derived(nodes).distinct()


def amendment_edges(amendments: DataFrame, year: int, order: str = "path") -> tuple[DataFrame, DataFrame]:
    """(edges dated 1 January of the year, rows whose target can't be resolved)."""
    dst = T.target_uid(F.col("target_section"))
    made = amendments.where(dst.isNotNull() & F.col("amendment_type").isin(list(AMENDMENT_TYPES))).select(F.col("amend_uid").alias("src"), dst.alias("dst"), F.col("amendment_type").alias("rel_type"), "new_text", F.col("removed_text").alias("old_text"), F.make_date(F.lit(year), F.lit(1), F.lit(1)).alias("effective_date"), F.col(order).alias("seq"))
    return made, amendments.where(dst.isNull())


def root_edge(spark_frame: DataFrame, src: str, rel: str, dst: str) -> DataFrame:
    return _edges(spark_frame.sparkSession.range(1), F.lit(src), F.lit(dst), F.lit(rel))


def link(nodes: DataFrame, kinds: Collection[str] | None = None, starts: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """All edges whose two ends exist, or those of some types, each once.

    An edge is found at a node, its one end, so the other end alone is looked up; only
    what can give edges of the types is read. Where the caller keeps only edges from or
    to some nodes of the graph, given as ``starts`` and ``targets``, others may be left
    out and these ends aren't looked up.
    """
    if kinds is None and starts is None and targets is None:
        return _every_link(nodes)
    wanted = lambda types: kinds is None or bool(set(kinds) & set(types))
    ends = lambda df: (nodes if df is None else materialize(df.select("uid"), "link-ends")).select("uid")
    parts, key = [], ["src", "rel_type", "dst"]
    at = nodes.where(F.col("uid").isNotNull())
    if wanted(CONTAINS.values()):
        parts.append(contained(at, kinds).join(ends(starts).withColumnRenamed("uid", "src"), "src", "left_semi").dropDuplicates(key))
    said = at if starts is None else starts.where(F.col("uid").isNotNull())
    found = [_referred(said, kinds)] if wanted(parse.KINDS) else []
    found += [derived_rules(said)] if wanted(("DERIVED_RULE",)) else []
    if found:
        parts.append(union_all(found).join(ends(targets).withColumnRenamed("uid", "dst"), "dst", "left_semi").dropDuplicates(key))
    return union_all(parts).select(EDGE) if parts else _edges(nodes.limit(0), F.col("uid"), F.col("uid"), F.col("label"))


def _every_link(nodes: DataFrame) -> DataFrame:
    """Edges of all types: ends that are odd are found first, edges themselves stay where their node is read.

    One shuffle of ends finds uids that no node has and those that several have. Both
    are few in a sound graph: edges to the former are left out, and only edges found at
    the latter are told apart.
    """
    at = nodes.where(F.col("uid").isNotNull())
    held, said = contained(at), materialize(union_all([_referred(at), derived_rules(at)]).select("src", "dst", "rel_type"), "link-said")
    end = lambda df, c, have: df.select(F.col(c).alias("end"), F.lit(have).cast("long").alias("have"))
    odd = union_all([end(at, "uid", 1), end(held, "src", 0), end(said, "dst", 0)]).groupBy("end").agg(F.sum("have").alias("have")).where("have <> 1")
    odd = materialize(odd, "link-odd")
    named = lambda some, c: odd.where(some).select(F.col("end").alias(c))
    parts = []
    for df, own, other in ((held.select("src", "dst", "rel_type"), "dst", "src"), (said, "src", "dst")):
        whole = df.join(named("have = 0", other), other, "left_anti")
        parts += [whole.join(named("have > 1", own), own, "left_anti"), whole.join(named("have > 1", own), own, "left_semi").dropDuplicates(["src", "rel_type", "dst"])]
    return _edges(union_all(parts), F.col("src"), F.col("dst"), F.col("rel_type")).select(EDGE)
