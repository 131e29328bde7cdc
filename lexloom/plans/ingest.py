"""From raw element JSON to a graph: nodes are parsed and written once, links are made from the written nodes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import link, parse, report
from lexloom.operators.graph import assert_unique, last_property_wins, union_all, upsert_edges
from lexloom.sources import files
from lexloom.tables import materialize

ACT, AMENDMENT, RULES = ("companies_act", "companies-act", "act_2013"), ("amendment",), ("rules",)


@dataclass(frozen=True)
class Loaded:
    nodes: DataFrame
    edges: DataFrame
    amendments: DataFrame
    unresolved: DataFrame


def clean(elements: DataFrame) -> DataFrame:
    return elements.withColumn("content", T.clean_element(F.coalesce("content", F.lit(""))))


def act_nodes(raw: DataFrame, uid: str, title: str, year: int) -> DataFrame:
    """Parsed act with mined definitions; one row a uid, the last of repeated ones."""
    parsed = parse.parse_act(clean(parse.flatten_elements(raw)), uid, title)
    every = parsed.unionByName(parse.mine_definitions(parsed))
    return last_property_wins(report.preprocess(every), ["label", "uid"]).withColumn("ord", F.lit(0).cast("long")).withColumn("year", F.when(F.col("label") == "Act", year))


def rule_nodes(raw: DataFrame, title: str) -> DataFrame:
    """Usable rules and their forms; rules dropped by the gate take their forms along."""
    parsed = report.preprocess(parse.parse_rules(clean(parse.flatten_elements(raw)), title))
    bad = report.usable_rules(parsed).where("drop_reason is not null").select("uid")
    kept = parsed.join(bad, "uid", "left_anti").join(bad.select(F.col("uid").alias("parent")), "parent", "left_anti")
    return last_property_wins(kept, ["label", "uid"]).withColumn("ord", F.lit(0).cast("long")).withColumn("year", F.lit(0))


def build(act: DataFrame, amendment: DataFrame, rules: DataFrame, act_uid: str = "act-companies-2013", amendment_uid: str = "amend-corporate-laws-2026", amendment_year: int = 2026, rules_title: str = "Companies Rules") -> Loaded:
    """Raw (source_pdf, json) frames of the three kinds -> nodes, edges, amendments."""
    changes = parse.parse_amendments(clean(parse.flatten_elements(amendment)), amendment_uid)
    # links read the nodes several times, so they are written once
    parts = [materialize(act_nodes(act, act_uid, "The Companies Act, 2013", 2013), "ingest-act"), materialize(rule_nodes(rules, rules_title), "ingest-rules")]
    root = act.sparkSession.range(1).select(F.lit(amendment_uid).alias("uid"), F.lit("AmendmentAct").alias("label"), F.lit("The Corporate Laws (Amendment) Act, 2026").alias("title"), F.lit("").alias("text"), F.lit(amendment_year).alias("year"))
    nodes = union_all([*parts, root])
    made, lost = link.amendment_edges(changes, amendment_year)
    made, _ = upsert_edges(nodes, made, link.AMENDMENT_TYPES)
    ruleset = parse.ruleset_uid(rules_title)
    roots = link.root_edge(act, amendment_uid, "AMENDED_BY", act_uid).unionByName(link.root_edge(act, ruleset, "PRESCRIBES_FOR", act_uid))
    edges = union_all([link.link(nodes), roots, made.withColumn("seq", F.lit(0).cast("long")).select(link.EDGE)])
    return Loaded(nodes, edges, changes, lost)


def ingest(spark: SparkSession, raw_dir: str, out_dir: str) -> Loaded:
    """Reads the raw files, writes nodes by label and edges by type, and returns the stored tables."""
    raw = files.raw_json(spark, raw_dir)
    made = build(files.matching(raw, ACT), files.matching(raw, AMENDMENT), files.matching(raw, RULES))
    assert_unique(made.nodes)
    # the jobs that write also count
    seen, linked = Observation("nodes"), Observation("edges")
    files.write_nodes(made.nodes.drop("quality").observe(seen, *report.kind_counts(), F.count("*").alias("nodes")), f"{out_dir}/nodes")
    files.write_edges(made.edges.observe(linked, F.count("*").alias("edges")), f"{out_dir}/edges")
    counts = spark.createDataFrame([{**seen.get, **linked.get}], ", ".join(f"{k} long" for k in (*report.KINDS, "nodes", "edges")))
    files.write_report(report.report_of(counts), f"{out_dir}/report")
    return Loaded(spark.read.parquet(f"{out_dir}/nodes"), spark.read.parquet(f"{out_dir}/edges"), made.amendments, made.unresolved)
