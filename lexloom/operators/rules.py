"""Rule sets from lines: rules and forms, by marked rows and windows.

Only headings open and close forms, and a paragraph opens a rule only where no
form is open. So the open form is a window over headings, the open rule one over
what opens rules, and all other lines go on the form, else on the rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators.graph import union_all
from lexloom.operators.lines import FIELDS, appended, group, nodes, numbered
from lexloom.tables import materialize

# --- Fixed values: the patterns of the documents' layout ---
RULE = r"(?id)^(?:Rule\s+)?(\d+[A-Za-z]?)\.\s+(.+)"
FORM = r"(?i)^Form\s+(?:No\.?\s*)?([A-Z]+-\d+[A-Z\-]*\d*|[A-Z]+\.\d+[A-Z\-]*)"
SCHEDULE = r"(?i)^SCHEDULE\s+([IVXLC]+)"
TABLE = "[TABLE CONTENT]"
LEAST_TITLE, MOST_HINDI = 3, 0.30
# --- end of fixed values ---


def read_rules(elements: DataFrame, keep_hindi: bool = False) -> DataFrame:
    """elements -> lines with kind (rule, form, end, more), name, title, and the open rule and form."""
    t = F.col("text")
    lines = numbered(elements)
    if not keep_hindi:
        lines = lines.where(~T.devanagari_majority(t, MOST_HINDI))
    heading, body, table = F.col("type") == "heading", F.col("type").isin("paragraph", "caption"), F.col("type").isin("table", "table row")
    title = F.regexp_replace(T.strip(group(t, RULE, 2)), r"\.+$", "")
    marks = lines.withColumn("title", title).withColumn("mark", F.when(heading & t.rlike(SCHEDULE), "end").when(heading & t.rlike(FORM), "form").when(heading & t.rlike(RULE), "rule"))
    before = W.partitionBy("source_pdf").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    marks = marks.withColumn("last", F.last(F.when(F.col("mark").isNotNull(), F.struct("mark", "pos")), ignorenulls=True).over(before)).withColumn("form_at", F.when(F.col("last.mark") == "form", F.col("last.pos")))
    starts = body & F.col("form_at").isNull() & t.rlike(RULE) & (F.length("title") > LEAST_TITLE)
    rows = marks.withColumn("kind", F.coalesce("mark", F.when(starts, "rule").when(body | table, "more"))).where("kind is not null")
    # the k-th rule of a file has k - 1 before it; a number that was seen gets that as its mark
    of_rules = (F.col("kind") == "rule").cast("int")
    rows = rows.withColumn("number", F.when(F.col("kind") == "rule", group(t, RULE))).withColumn("k", F.coalesce(F.sum(of_rules).over(before), F.lit(0)))
    again = F.row_number().over(W.partitionBy("source_pdf", "number").orderBy("pos")) > 1
    name = F.when(F.col("kind") == "rule", F.when(again, F.concat("number", F.lit("-dup-"), F.col("k").cast("string"))).otherwise(F.col("number"))).when(F.col("kind") == "form", F.upper(group(t, FORM)))
    rows = rows.withColumn("name", name)
    rule = F.last(F.when(F.col("kind").isin("rule", "end"), F.struct(F.col("pos").alias("at"), F.when(F.col("kind") == "rule", F.col("name")).alias("name"))), ignorenulls=True).over(before)
    return materialize(rows.withColumn("rule", rule).select("source_pdf", "pos", "kind", F.when(table, TABLE).otherwise(t).alias("text"), table.alias("is_table"), "page", "name", "title", "rule", "form_at"), "rules-lines")


def _target():
    return F.coalesce("form_at", F.when(F.col("rule.name").isNotNull(), F.col("rule.at")))


def rule_nodes(read: DataFrame, uid: str, set_title: str) -> DataFrame:
    order = F.col("pos")
    root = nodes(read.select("source_pdf", F.lit(1).alias("page")).distinct(), "RuleSet", uid=F.lit(uid), title=F.lit(set_title), text=F.lit(""), ord=F.lit(0).cast("long"))
    more = appended(read.where("kind = 'more'"), _target())
    whole = read.withColumn("at", F.col("pos")).join(more, ["source_pdf", "at"], "left").withColumn("whole", F.coalesce("more", F.lit("")))
    rules = nodes(whole.where("kind = 'rule'"), "Rule", uid=F.concat(F.lit("rule-"), "name"), parent=F.lit(uid), number="name", title="title", text="whole", ord=order)
    holder = F.when(F.col("rule.name").isNotNull(), F.concat(F.lit("rule-"), "rule.name")).otherwise(uid)
    forms = nodes(whole.where("kind = 'form'"), "Form", uid=F.concat(F.lit("form-"), T.slugify(F.col("name"))), parent=holder, form_number="name", title="text", associated_rule=F.coalesce("rule.name", F.lit("")), text="whole", ord=order)
    return union_all([root, rules, forms]).select(FIELDS)


def rule_warnings(read: DataFrame) -> DataFrame:
    """source_pdf, page, message of the lines that found no place; tables without one are passed over."""
    lost = read.where((F.col("kind") == "more") & ~F.col("is_table") & _target().isNull())
    return lost.select("source_pdf", "page", "pos", F.concat(F.lit("unattached: "), F.substring("text", 1, 80)).alias("message"))


def parse_rules(elements: DataFrame, title: str, keep_hindi: bool = False) -> DataFrame:
    return rule_nodes(read_rules(elements, keep_hindi), ruleset_uid(title), title)


def ruleset_uid(title: str) -> str:
    return "ruleset-" + "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in title.lower()).split())
