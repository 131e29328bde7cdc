"""Reports over node tables: counts, coverage, quality, integrity, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators.graph import ROOTS, ancestor_headers, nearest_rank, union_all, walk
from lexloom.operators.link import AMENDMENT_TYPES
from lexloom.tables import materialize

SECTIONS, MISSING, MOST_WARNINGS = 470, 30, 50
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


KINDS = ("Chapter", "Section", "SubSection", "Clause", "SubClause", "Proviso", "Explanation", "Definition", "Rule", "Form")


def kind_counts() -> list[Column]:
    """Nodes of each kind, as aggregates: for a report, or to be observed while nodes are written."""
    return [F.count_if(F.col("label") == k).alias(k) for k in KINDS]


def parse_report(nodes: DataFrame, expected: int = SECTIONS) -> DataFrame:
    """One row: nodes of each kind, coverage of sections and warnings of the ingest."""
    return report_of(nodes.agg(*kind_counts()), expected)


def report_of(counts: DataFrame, expected: int = SECTIONS) -> DataFrame:
    """The report from a row of ``kind_counts``."""
    coverage = F.least(F.round(F.col("Section") / expected * 100, 1), F.lit(100.0))
    checks = [(F.col("Section") < 400, "few sections"), (F.col("Definition") < 50, "few definitions"), (F.col("Proviso") == 0, "no provisos"), (F.col("Rule") < 30, "few rules")]
    return counts.withColumn("coverage_pct", coverage).withColumn("warnings", F.array_compact(F.array(*[F.when(c, w) for c, w in checks])))


def preprocess(nodes: DataFrame) -> DataFrame:
    """Nodes with clean text, language, quality and the text for language models.

    Definitions, provisos and explanations keep their text and get no score;
    footnotes leave sections of over 2000 characters after scoring.
    """
    plain = F.col("label").isin("Definition", "Proviso", "Explanation")
    clean = F.when(plain, F.col("text")).otherwise(T.strip_form_templates(T.normalize(F.coalesce(F.col("text"), F.lit("")))))
    out = nodes.withColumn("text", clean).withColumn("language", T.script_language(F.col("text")))
    out = out.withColumn("quality", F.when(~plain, T.quality(F.col("text"), F.col("label"))))
    out = out.withColumn("text", F.when((F.col("label") == "Section") & (F.length("text") > 2000), T.without_footnotes(F.col("text"))).otherwise(F.col("text")))
    head = F.when(F.col("title").isNotNull() & (F.col("title") != ""), F.concat(F.lit(" ("), "title", F.lit(")"))).otherwise("")
    llm = F.when(F.col("label") == "Section", F.concat(F.lit("Section "), "number", head, F.lit("\n\n"), "text")).when(F.col("label") == "Rule", F.concat(F.lit("Rule "), "number", head, F.when(F.col("language") != "en", F.concat(F.lit(" [lang:"), "language", F.lit("]"))).otherwise(""), F.lit("\n\n"), "text")).when(F.col("label") == "Definition", F.concat(F.lit('Definition: "'), "term", F.lit('" [Section 2]\n\n'), "text"))
    return out.withColumn("llm_text", llm).withColumn("quality_score", F.bround("quality.score", 1))


def in_context(nodes: DataFrame) -> DataFrame:
    """Preprocessed nodes whose text for language models says where they stand.

    A section's text begins with its chapter, a rule's with its set of rules; nodes
    that have no text of their own for models get their text under the path of their
    ancestors.
    """
    up = nodes.select(F.col("uid").alias("parent"), F.col("label").alias("_label"), F.col("number").alias("_number"), F.col("title").alias("_title")).dropDuplicates(["parent"])
    chapter, rules = (F.col("label") == "Section") & (F.col("_label") == "Chapter"), (F.col("label") == "Rule") & (F.col("_label") == "RuleSet") & (F.coalesce("_title", F.lit("")) != "")
    headed = nodes.join(up, "parent", "left").withColumn("llm_text", F.when(chapter, F.concat(F.lit("Chapter "), "_number", F.lit(" - "), F.coalesce("_title", F.lit("")), F.lit(" > "), "llm_text")).when(rules, F.concat("_title", F.lit(" > "), "llm_text")).otherwise(F.col("llm_text")))
    name = F.concat(F.col("label"), F.when(F.coalesce("number", F.lit("")) != "", F.concat(F.lit(" "), "number")).otherwise(""))
    paths = ancestor_headers(nodes, name)
    text = F.coalesce("llm_text", F.when((F.size("path") > 0) & (F.coalesce("text", F.lit("")) != ""), F.concat(F.array_join("path", " > "), F.lit("\n\n"), "text")))
    return headed.join(paths, "uid", "left").withColumn("llm_text", text).select(nodes.columns)


def usable_rules(nodes: DataFrame, most: int = 500) -> DataFrame:
    """drop_reason of rules: garbled, empty, unusable, or a number beyond any real one."""
    n = F.expr("try_cast(regexp_extract(number, '^([0-9]+)', 1) as int)")
    reason = F.when(T.is_garbled(F.col("text")), "garbled").when(F.length(T.strip(F.coalesce("text", F.lit("")))) == 0, "empty").when(~T.quality(F.col("text"), F.col("label"))["is_usable"], "unusable").when(n > most, "number")
    return nodes.where("label = 'Rule'").withColumn("drop_reason", reason)


def audit(nodes: DataFrame) -> DataFrame:
    """One row: sizes and quality of a label's texts."""
    s, n = F.col("s"), F.length(F.coalesce("text", F.lit("")))
    scored = nodes.withColumn("s", T.audit_score(F.col("text")))
    return scored.agg(F.count("*").alias("nodes"), F.count_if(n == 0).alias("empty"), F.count_if((n > 0) & (n < 50)).alias("short"), F.count_if(n > 5000).alias("oversized"), F.count_if(s < 30).alias("poor"), F.count_if(s >= 70).alias("good"), F.coalesce(F.avg(s), F.lit(0.0)).alias("mean"), F.coalesce(F.median(s), F.lit(0.0)).alias("median"))


def missing_sections(nodes: DataFrame, expected: int = SECTIONS) -> DataFrame:
    have = nodes.where("label = 'Section'").select(F.expr("try_cast(number as long)").alias("id"))
    return nodes.sparkSession.range(1, expected + 1).join(have, "id", "left_anti").orderBy("id")


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """check, n: orphans, edges with a missing end, repeated keys.

    One shuffle of ends counts for each uid its nodes and the edges that lead to it; only
    uids where these don't fit are kept, and keys are compared for uids of several nodes.
    """
    end = lambda df, c, **n: df.select(F.col(c).alias("end"), *[n.get(k, F.lit(0)).cast("long").alias(k) for k in ("have", "loose", "into")])
    loose = F.coalesce((~F.col("label").isin(list(ROOTS))).cast("long"), F.lit(0))
    ends = end(nodes, "uid", have=F.lit(1), loose=loose).unionByName(end(edges, "dst", into=F.lit(1)))
    none = F.col("end").isNull()  # no end equals a null one
    odd = ends.groupBy("end").agg(*[F.sum(k).alias(k) for k in ("have", "loose", "into")]).where(none | (F.col("have") != 1) | (F.col("into") == 0) & (F.col("loose") > 0))
    odd = materialize(odd, "integrity-odd")
    several = odd.where("have > 1").select(F.col("end").alias("_end"))
    twice = nodes.join(several, F.col("uid").eqNullSafe(F.col("_end")), "left_semi").groupBy("label", "uid").count().where("count > 1")
    total = lambda n, some: F.coalesce(F.sum(F.when(some, F.col(n))), F.lit(0).cast("long")).alias("n")
    checks = [odd.agg(total("loose", none | (F.col("into") == 0))), odd.agg(total("into", none | (F.col("have") == 0))), twice.agg(F.count("*").alias("n"))]
    return union_all([n.select(F.lit(name).alias("check"), "n") for name, n in zip(("orphans", "broken_edges", "repeated_uids"), checks, strict=True)])


def evaluation(runs: DataFrame) -> DataFrame:
    """category (null: all of them), n, rates, mean latency and its percentiles by rank, of recorded answers."""
    every = runs.withColumn("category", F.explode(F.array(F.lit(None).cast("string"), F.col("category"))))
    ok = F.col("status") == "ok"
    rates = every.groupBy("category").agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("ok_rate"), F.avg(F.when(ok, F.col("answer_ok").cast("double"))).alias("answer_rate"), F.avg(F.when(ok, F.col("latency_ms"))).alias("mean_ms"))
    timed = every.where(ok & F.col("latency_ms").isNotNull()).select(F.coalesce("category", F.lit("")).alias("key"), "latency_ms")
    ranks = nearest_rank(timed, "key", "latency_ms", {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99}).drop("n")
    return rates.join(ranks, F.coalesce("category", F.lit("")) == F.col("key"), "left").drop("key")


def amendment_report(amendments: DataFrame) -> DataFrame:
    """One row: amendments, share of known types, and warnings about those without a type, target or text."""
    known = F.coalesce(F.col("amendment_type").isin(list(AMENDMENT_TYPES)), F.lit(False))
    target = F.coalesce(F.col("target_section").rlike("^section \\d+$"), F.lit(False))
    warning = F.when(~known, F.concat(F.lit("no known type: "), F.substring("raw_text", 1, 80))).when(~target, F.concat(F.lit("no target: "), F.substring("raw_text", 1, 80)))
    # the first by order: a limit, which each task applies before its rows go on
    few = amendments.where(warning.isNotNull()).select(warning.alias("w")).distinct().orderBy("w").limit(MOST_WARNINGS)
    first = few.agg(F.array_sort(F.collect_list("w")).alias("warnings"))
    return amendments.agg(F.count("*").alias("amendments"), F.round(F.avg(known.cast("double")) * 100, 1).alias("valid_type_pct"), F.count_if(F.coalesce("new_text", F.lit("")) != "").alias("with_text"), F.count(warning).alias("warned")).crossJoin(first)  # one row each


def rules_report(nodes: DataFrame) -> DataFrame:
    """One row: rules, forms, and the share of rules with a title."""
    rule = F.col("label") == "Rule"
    titled = F.avg(F.when(rule, (F.coalesce("title", F.lit("")) != "").cast("double")))
    return nodes.agg(F.count_if(rule).alias("rules"), F.count_if(F.col("label") == "Form").alias("forms"), F.round(F.coalesce(titled, F.lit(0.0)) * 100, 1).alias("titled_pct"))


def load_summary(nodes: DataFrame, attempted: DataFrame, created: DataFrame) -> DataFrame:
    """One row: nodes, edges attempted and edges whose two ends exist."""
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((nodes, "nodes"), (attempted, "edges_attempted"), (created, "edges_created"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


def preprocess_report(nodes: DataFrame) -> DataFrame:
    """label, nodes, usable, with issues, characters and mean quality of preprocessed nodes."""
    scored = nodes.where("quality is not null")
    return scored.groupBy("label").agg(F.count("*").alias("nodes"), F.count_if("quality.is_usable").alias("usable"), F.count_if(F.size("quality.issues") > 0).alias("with_issues"), F.sum("quality.text_length").alias("characters"), F.round(F.avg("quality.score"), 2).alias("mean_quality"))


def compare_preprocess(before: DataFrame, after: DataFrame) -> DataFrame:
    """label and, before and after cleaning: nodes, characters, empty ones, mean quality of the text."""
    def side(df: DataFrame, name: str) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        return df.groupBy("label").agg(F.count("*").alias(f"nodes_{name}"), F.sum(F.length(text)).alias(f"characters_{name}"), F.count_if(text == "").alias(f"empty_{name}"), F.round(F.avg(T.quality(F.col("text"), F.col("label"))["score"]), 2).alias(f"quality_{name}"))

    return side(before, "before").join(side(after, "after"), "label", "full_outer")


def depths(nodes: DataFrame) -> DataFrame:
    """uid, label, depth below its root; nodes that no root reaches have no depth."""
    nodes = materialize(nodes.select("uid", "label", "parent"), "depths-nodes")  # read by the walk and for labels
    return nodes.select("uid", "label").distinct().join(walk(nodes).select("uid", "depth"), "uid").select("uid", "label", "depth")


def unrooted(nodes: DataFrame) -> DataFrame:
    """uid, label and state (``lost`` or ``cycle``) of nodes that no root reaches."""
    return nodes.select("uid", "label").distinct().join(walk(nodes).where("state <> 'reached'").select("uid", "state"), "uid")


def worst(nodes: DataFrame, n: int = 10, score: Callable[[Column], Column] = T.audit_score) -> DataFrame:
    """The n nodes of least audit score, those without uid last among equals."""
    return nodes.select("uid", "label", score(F.col("text")).alias("score")).orderBy("score", F.asc_nulls_last("uid")).limit(n)


def gaps(nodes: DataFrame, amendments: DataFrame, expected: int = SECTIONS) -> DataFrame:
    """severity, gap, found: rules over roll-ups of the audit that are broken, worst severity first."""
    length = F.length(F.coalesce("text", F.lit("")))
    of = lambda label: F.col("label") == label
    sums = nodes.agg(F.count_if(of("Section")).alias("sections"), F.count_if(of("Section") & (length < 50)).alias("short_sections"), F.count_if(of("Rule")).alias("rules"), F.count_if(of("Rule") & (length == 0)).alias("empty_rules"), F.count_if(length > 5000).alias("oversized"), F.count_if(T.is_garbled(F.col("text")) & (length > 0)).alias("garbled"))
    texts = amendments.agg(F.count("*").alias("amendments"), F.count_if(F.coalesce("new_text", F.lit("")) == "").alias("without_text"))
    rules = [("CRITICAL", "sections are missing", F.greatest(F.lit(expected) - F.col("sections"), F.lit(0))), ("CRITICAL", "texts are garbled", F.col("garbled")), ("HIGH", "amendments have no new text", F.col("without_text")), ("HIGH", "rules are empty", F.col("empty_rules")), ("MEDIUM", "sections are short", F.col("short_sections")), ("LOW", "texts are oversized", F.col("oversized"))]
    each = sums.crossJoin(texts).select(F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(g).alias("gap"), n.cast("long").alias("found")) for s, g, n in rules])).alias("x")).select("x.*")  # one row each
    return each.where("found > 0").orderBy(_rank(F.col("severity")), "gap")


def _rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)


def severity_counts(found: DataFrame) -> DataFrame:
    """One row: gaps of each severity."""
    return found.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])


def audit_report(nodes: DataFrame, amendments: DataFrame, expected: int = SECTIONS) -> dict[str, DataFrame]:
    """The parts of an audit: sums by label, depths, worst nodes, missing sections, gaps and their severities."""
    found = gaps(nodes, amendments, expected)
    below = depths(nodes).groupBy("label", "depth").agg(F.count("*").alias("nodes"))
    return {"labels": preprocess_report(preprocess(nodes)), "depths": below, "worst": worst(nodes), "missing": missing_sections(nodes, expected).limit(MISSING), "gaps": found, "severities": severity_counts(found)}


def write_audit(parts: dict[str, DataFrame], path: str) -> None:
    """One JSON folder for each part."""
    for name, part in parts.items():
        part.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
