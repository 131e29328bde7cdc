"""The question templates over nodes and edges: each returns a DataFrame.

A template's branches are aggregated before they are joined, so optional
branches never multiply each other.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.link import AMENDMENT_TYPES

TEMPLATES: dict[str, Callable[..., DataFrame]] = {}
PENAL = "penalty|liable|fine"


def template(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    TEMPLATES[f.__name__] = f
    return f


@dataclass(frozen=True)
class Graph:
    """Nodes and edges; ``edges_by_dst`` are the same edges, laid out for joins on their targets (see ``stored``)."""

    nodes: DataFrame
    edges: DataFrame
    edges_by_dst: DataFrame | None = None

    def of(self, label: str) -> DataFrame:
        return self.nodes.where(F.col("label") == label)

    def section(self, n: str) -> DataFrame:
        return self.of("Section").where(F.col("number") == str(n))

    def hop(self, rel: str | list[str], src: str = "src", dst: str = "dst", by: str = "src", starts: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
        """Edges of some types; ``by`` is the end that they are joined on first.

        ``starts`` and ``targets`` are nodes: the caller keeps only edges from and to them,
        so that a graph which finds its edges may leave others out.
        """
        rels = [rel] if isinstance(rel, str) else rel
        edges = self.edges_by_dst if by == "dst" and self.edges_by_dst is not None else self.edges
        return edges.where(F.col("rel_type").isin(rels)).select(F.col("src").alias(src), F.col("dst").alias(dst), "rel_type", "new_text", "old_text", "effective_date", "seq")

    def children(self, parents: DataFrame, rel: str, label: str) -> DataFrame:
        """parent uid and the child's columns."""
        return parents.select(F.col("uid").alias("parent_uid")).join(self.hop(rel, starts=parents), F.col("parent_uid") == F.col("src")).select("parent_uid", F.col("dst").alias("uid")).join(self.of(label).drop("parent"), "uid")


def _texts(column: str, alias: str) -> Column:
    return F.array_sort(F.collect_set(column)).alias(alias)


def _in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.expr("try_cast(number as int)").asc_nulls_last(), F.asc_nulls_last("number"), "uid")


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


@template
def section_by_number(g: Graph, n: str) -> DataFrame:
    return g.section(n).select("uid", "title", "text")


@template
def definitions_like(g: Graph, term: str) -> DataFrame:
    return g.of("Definition").where(F.col("term").contains(term)).select("uid", "term", "text").orderBy("uid")


@template
def rule_by_number(g: Graph, n: str) -> DataFrame:
    return g.of("Rule").where(F.col("number") == str(n)).select("uid", "title", "text")


@template
def subsections_of(g: Graph, n: str) -> DataFrame:
    return _in_order(g.children(g.section(n), "HAS_SUBSECTION", "SubSection").select("uid", "number", "text"))


@template
def meaning_of(g: Graph, term: str) -> DataFrame:
    a = g.of("Definition").where(F.contains(F.lower("term"), F.lit(term.lower()))).select("uid", F.col("term").alias("name"), "text")
    b = g.children(g.section("2"), "HAS_SUBSECTION", "SubSection").where(F.contains(F.lower("text"), F.lit(term.lower()))).select("uid", F.col("number").alias("name"), "text")
    return a.unionByName(b).distinct().orderBy("uid", "name")


@template
def section_with_subsections(g: Graph, n: str) -> DataFrame:
    subs = g.children(g.section(n), "HAS_SUBSECTION", "SubSection").groupBy("parent_uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("subsections"))
    return g.section(n).join(subs, F.col("uid") == F.col("parent_uid"), "left").select("uid", "title", "text", F.coalesce("subsections", F.array().cast("array<string>")).alias("subsections"))


@template
def all_definitions(g: Graph) -> DataFrame:
    return g.of("Definition").select("uid", "term", "text").orderBy(F.asc_nulls_last("term"), "uid")


@template
def schedule_by_number(g: Graph, n: str) -> DataFrame:
    return g.of("Schedule").where(F.col("number") == n).select("uid", "title", "text")


def _amendments(g: Graph, sections: DataFrame, rels: list[str]) -> DataFrame:
    s = sections.select(F.col("uid").alias("section_uid"), "number", "title")
    by = g.of("AmendmentAct").select(F.col("uid").alias("amendment_uid"), F.col("title").alias("amendment_title"))
    return g.hop(rels, "amendment_uid", "section_uid", by="dst").join(s, "section_uid").join(by, "amendment_uid")


@template
def amendments_of(g: Graph, n: str) -> DataFrame:
    return _amendments(g, g.section(n), list(AMENDMENT_TYPES)).select("amendment_uid", "amendment_title", "rel_type", "old_text", "new_text", "effective_date").orderBy(F.asc_nulls_last("effective_date"), "amendment_uid", "rel_type")


@template
def sections_changed(g: Graph, rel: str) -> DataFrame:
    return _in_order(_amendments(g, g.of("Section"), [rel]).select(F.col("section_uid").alias("uid"), "number", "title", "amendment_uid", "new_text", "effective_date"))


@template
def changed_by(g: Graph, amendment_uid: str, rel: str | None = None, limit: int | None = 25) -> DataFrame:
    return _first(_amendments(g, g.of("Section"), [rel] if rel else list(AMENDMENT_TYPES)).where(F.col("amendment_uid") == amendment_uid).select(F.col("section_uid").alias("uid"), "number", "title", "rel_type").orderBy("uid", "rel_type"), limit)


@template
def section_with_amendments(g: Graph, n: str) -> DataFrame:
    per = _amendments(g, g.section(n), list(AMENDMENT_TYPES)).groupBy("section_uid").agg(F.array_sort(F.collect_set(F.struct(F.col("rel_type").alias("type"), "new_text", "old_text"))).alias("amendments"))
    subs = g.children(g.section(n), "HAS_SUBSECTION", "SubSection").groupBy("parent_uid").agg(_texts("text", "subsections"))
    s = g.section(n).select("uid", "title", "text")
    return s.join(per, F.col("uid") == F.col("section_uid"), "left").join(subs, F.col("uid") == F.col("parent_uid"), "left").select("uid", "title", "text", "subsections", "amendments")


@template
def amended_sections(g: Graph, limit: int | None = 25) -> DataFrame:
    return _first(_in_order(_amendments(g, g.of("Section"), list(AMENDMENT_TYPES)).select(F.col("section_uid").alias("uid"), "number", "title", "rel_type", "amendment_uid", "effective_date")), limit)


@template
def amendments_in_chapter(g: Graph, chapter: str) -> DataFrame:
    inside = g.children(g.of("Chapter").where(F.col("number") == chapter), "HAS_SECTION", "Section")
    return _amendments(g, inside, list(AMENDMENT_TYPES)).select(F.col("section_uid").alias("uid"), "title", "rel_type", "amendment_uid").orderBy("uid", "rel_type")


@template
def references_to(g: Graph, n: str, rels: tuple[str, ...] = ("REFERS_TO",)) -> DataFrame:
    t = g.section(n).select(F.col("uid").alias("dst"))
    return g.hop(list(rels), by="dst").join(t, "dst", "left_semi").join(g.nodes.select(F.col("uid").alias("src"), "label", "text"), "src").select(F.col("src").alias("uid"), F.col("label").alias("type"), "rel_type", "text").orderBy("uid", "rel_type")


@template
def subject_to_of(g: Graph, n: str) -> DataFrame:
    whole = g.section(n).select("uid").unionByName(g.children(g.section(n), "HAS_SUBSECTION", "SubSection").select("uid"))
    edges = g.hop("SUBJECT_TO").join(whole.withColumnRenamed("uid", "src"), "src")
    return edges.join(g.nodes.select(F.col("uid").alias("dst"), "title"), "dst").select(F.col("src").alias("uid"), F.col("dst").alias("target_uid"), "title").orderBy("uid", "target_uid")


@template
def notwithstanding_pairs(g: Graph) -> DataFrame:
    a = g.nodes.select(F.col("uid").alias("src"), F.col("label").alias("source_type"))
    b = g.nodes.select(F.col("uid").alias("dst"), F.col("label").alias("target_type"))
    return g.hop("NOTWITHSTANDING").join(a, "src").join(b, "dst").select(F.col("src").alias("uid"), "source_type", F.col("dst").alias("target_uid"), "target_type").orderBy("uid", "target_uid")


@template
def rules_for(g: Graph, n: str, rels: tuple[str, ...] = ("REFERS_TO", "PRESCRIBES_FOR", "DERIVED_RULE")) -> DataFrame:
    t = g.section(n).select(F.col("uid").alias("dst"))
    return g.hop(list(rels), by="dst").join(t, "dst", "left_semi").join(g.of("Rule").select(F.col("uid").alias("src"), "number", "title", "text"), "src").select(F.col("src").alias("uid"), "number", "title", "text", "rel_type").orderBy("uid", "rel_type")


@template
def chapters_without_rules(g: Graph) -> DataFrame:
    ruled = g.hop(["REFERS_TO", "PRESCRIBES_FOR", "DERIVED_RULE"], starts=g.of("Rule"), targets=g.of("Section")).join(g.of("Rule").select(F.col("uid").alias("src")), "src", "left_semi")
    bare = g.of("Section").join(ruled.select(F.col("dst").alias("uid")), "uid", "left_anti").select("uid")
    per = g.hop("HAS_SECTION", by="dst", starts=g.of("Chapter")).join(bare.withColumnRenamed("uid", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("uid")).agg(F.count("*").alias("sections"))
    return g.of("Chapter").select("uid", "number", "title").join(per, "uid").orderBy(F.asc_nulls_last("number"))


@template
def penalty_bundle(g: Graph, n: str) -> DataFrame:
    rules = rules_for(g, n).select(F.lit(None).cast("string").alias("x"), "uid").agg(_texts("uid", "rules"))  # first: the nodes that its hop writes are read by the others
    s = g.section(n).select("uid", "title", "text")
    subs = g.children(g.section(n), "HAS_SUBSECTION", "SubSection")
    holders = g.section(n).select("uid", F.col("uid").alias("top")).unionByName(subs.select("uid", F.col("parent_uid").alias("top")))
    clauses = g.children(holders, "HAS_CLAUSE", "Clause").join(holders.select(F.col("uid").alias("parent_uid"), "top"), "parent_uid")
    deep = g.children(clauses, "HAS_SUBCLAUSE", "SubClause").join(clauses.select(F.col("uid").alias("parent_uid"), "top"), "parent_uid")
    item = lambda name: F.array_sort(F.collect_set(F.struct("uid", "text"))).alias(name)
    branches = [subs.groupBy(F.col("parent_uid").alias("top")).agg(item("subsections")), clauses.groupBy("top").agg(item("clauses")), deep.groupBy("top").agg(item("subclauses"))]
    for b in branches:
        s = s.join(b.withColumnRenamed("top", "uid"), "uid", "left")
    return s.crossJoin(rules)  # one row each


@template
def penal_subsections(g: Graph, n: str) -> DataFrame:
    hits = g.children(g.section(n), "HAS_SUBSECTION", "SubSection").where(F.col("text").rlike(PENAL)).groupBy("parent_uid").agg(_texts("text", "penalties"))
    return g.section(n).select("uid", "title", "text").join(hits, F.col("uid") == F.col("parent_uid"), "left").drop("parent_uid")


@template
def liabilities(g: Graph) -> DataFrame:
    some = g.of("Section").where(F.col("text").contains("liable") | F.col("text").contains("liability"))
    hits = g.children(some, "HAS_SUBSECTION", "SubSection").where(F.col("text").rlike(PENAL)).groupBy("parent_uid").agg(F.array_sort(F.collect_list("text")).alias("penalties"))
    return _in_order(some.join(hits, F.col("uid") == F.col("parent_uid"), "left").select("uid", "number", "title", "penalties"))


@template
def sections_of_chapter(g: Graph, chapter: str) -> DataFrame:
    return _in_order(g.children(g.of("Chapter").where(F.col("number") == chapter), "HAS_SECTION", "Section").select("uid", "number", "title"))


@template
def sections_of_chapters_like(g: Graph, words: str) -> DataFrame:
    some = g.of("Chapter").where(F.upper("title").contains(words.upper()))
    return _in_order(g.children(some, "HAS_SECTION", "Section").select("uid", "number", "title"))


@template
def count_sections(g: Graph) -> DataFrame:
    return g.of("Section").agg(F.count("uid").alias("sections"))


@template
def count_chapters(g: Graph) -> DataFrame:
    return g.children(g.of("Act"), "HAS_CHAPTER", "Chapter").agg(F.count("uid").alias("chapters"))


@template
def chapters_with_counts(g: Graph, limit: int | None = 50) -> DataFrame:
    per = g.hop("HAS_SECTION", starts=g.of("Chapter")).groupBy(F.col("src").alias("uid")).agg(F.count("dst").alias("n"))
    return _first(g.of("Chapter").select("uid", "number", "title").join(per, "uid", "left").select("uid", "number", "title", F.coalesce("n", F.lit(0).cast("long")).alias("sections")).orderBy(F.asc_nulls_last("number")), limit)


@template
def chapters(g: Graph) -> DataFrame:
    return g.children(g.of("Act"), "HAS_CHAPTER", "Chapter").select("uid", "number", "title").orderBy(F.asc_nulls_last("number"))


@template
def sections_mentioning(g: Graph, words: str, limit: int | None = 10) -> DataFrame:
    return _first(_in_order(g.of("Section").where(F.col("text").contains(words) | F.col("title").contains(words)).select("uid", "number", "title", "text")), limit)


@template
def rules_preview(g: Graph, limit: int | None = 25) -> DataFrame:
    return _first(_in_order(g.children(g.of("RuleSet"), "HAS_RULE", "Rule").select("uid", "number", "title", F.substring("text", 1, 150).alias("preview"))), limit)


@template
def label_counts(g: Graph) -> DataFrame:
    return g.nodes.groupBy("label").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label")


@template
def rel_counts(g: Graph) -> DataFrame:
    return g.edges.groupBy("rel_type").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "rel_type")
