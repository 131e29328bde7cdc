"""Acts from lines: chapters, sections and their parts, by marked rows and windows.

Each line gets its kind from its wording alone. What is open where it stands (the
chapter, section, subsection, clause and subclause) is the last line of each kind
before it, and a part counts only if it is younger than what holds it. A line
without a kind of its own goes on the deepest open node.

One rule looks back at text already gathered: a section whose number was seen
before replaces the earlier one (a line of the table of contents) if it is longer
than REPLACES times that one's text so far, and PLUS more; otherwise it goes on
like any other line. Since that depends on decisions about earlier lines alone,
decisions are computed for all lines from those of the last round until a round
changes none: each round settles at least one more line, and two or three do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators.graph import union_all
from lexloom.operators.lines import BEFORE, FIELDS, appended, group, nodes, numbered_in_blocks, with_latest
from lexloom.tables import materialize, release

# --- Fixed values: the patterns of the documents' layout ---
CHAPTER = r"(?i)^CHAPTER\s+([IVXLC]+)"
SECTION = r"(?d)^(\d+)\.\s+(.+?)(?:\.[\s—\-]*(?:\(|$)|\.?--|\.\s*$|\.?\s*\()"
SUBSECTION = r"^\((\d+)\)\s+"
CLAUSE = r"^\(([a-z])\)\s+"
SUBCLAUSE = r"^\(([ivxlc]+)\)\s+"
PROVISO = r"(?i)^Provided\s+(also\s+|further\s+)?that\b"
EXPLANATION = r"(?i)^Explanation(\s+[IVX]+)?[.\-—]\s*"
DEFINED = r"(?i)^(?:\(\d+\)\s*)?[\"“‘']([^\"”’']+)[\"”’']\s+(?:means(?:\s+and\s+includes)?|shall\s+mean|includes|shall\s+include)\b"
FOOTNOTE = r"(?i)Ins\.\s+by|Subs\.\s+by|w\.e\.f\.|Notification\s+No\.|S\.O\.\s+\d|G\.S\.R\.\s+\d|vide\s+notification|Gazette\s+of\s+India"
NO_NOTE = r"(?i)^(?:PART|SCHEDULE|ANNEXURE) "
REPLACES, PLUS = 1.5, 20
UNKNOWN, PRELIMINARY = "UNKNOWN", "PRELIMINARY"
# --- end of fixed values ---



def is_footnote(text: Column) -> Column:
    return F.substring(text, 1, 80).rlike(FOOTNOTE) & ~(text.rlike(r"^\d+\.\s+[A-Z]") & (F.length(text) > 100))


def _plain(number: Column) -> Column:
    return F.regexp_replace(number, r"^0+(?=\d)", "")


def marked(numbered: DataFrame) -> DataFrame:
    """Numbered lines with kind, name (number, letter or term) and title, all from their own wording."""
    t, heading = F.col("text"), F.col("type") == "heading"
    section = t.rlike(SECTION)
    kind = (
        F.when(t.rlike(CHAPTER), "chapter").when(heading, "heading").when(section, F.when(is_footnote(t), "more").otherwise("section")).when(t.rlike(SUBSECTION), "subsection").when(t.rlike(CLAUSE), "clause")
        .when(t.rlike(SUBCLAUSE), "subclause").when(t.rlike(PROVISO), "proviso").when(t.rlike(EXPLANATION), "explanation").when(t.rlike(DEFINED), "definition").otherwise("more")
    )
    name = (
        F.when(F.col("kind") == "chapter", F.upper(group(t, CHAPTER))).when(F.col("kind") == "section", _plain(group(t, SECTION))).when(F.col("kind") == "subsection", _plain(group(t, SUBSECTION)))
        .when(F.col("kind") == "clause", group(t, CLAUSE)).when(F.col("kind") == "subclause", group(t, SUBCLAUSE)).when(F.col("kind") == "explanation", T.strip(F.regexp_extract(t, EXPLANATION, 1))).when(F.col("kind") == "definition", T.strip(group(t, DEFINED)))
    )
    rest = T.strip(F.regexp_replace(t, CHAPTER, ""))
    title = F.when((F.col("kind") == "chapter") & ~heading, rest).when(F.col("kind") == "section", F.regexp_replace(T.strip(group(t, SECTION, 2)), r"\.+$", ""))
    lines = numbered.where(F.col("type").isin("heading", "paragraph", "caption"))
    return lines.withColumn("kind", kind).withColumn("name", name).withColumn("title", title)


def placed(lines: DataFrame, refused: DataFrame) -> DataFrame:
    """Lines with what is open where they stand, given the section lines that open nothing."""
    known = lines.join(refused.withColumn("refused", F.lit(True)), ["source_pdf", "pos"], "left")
    kind = F.col("kind")
    opens = (kind == "section") & F.col("refused").isNull()
    event = lambda at, name: F.when(at, F.struct(F.col("pos").alias("at"), name.alias("name")))
    events = {"chapter": event(kind == "chapter", F.col("name")), "section": event(F.col("opens") | (kind == "chapter"), F.when(F.col("opens"), F.col("name")))} | {k: event(kind == k, F.col("name")) for k in ("subsection", "clause", "subclause")}
    rows = with_latest(known.withColumn("opens", opens), **events).select(*lines.columns, "opens", ((kind == "more") | (kind == "section") & ~F.col("opens")).alias("goes_on"), *events)
    # a part is open if it is younger than all that could hold it
    inside = F.col("section.name").isNotNull()
    sub = inside & (F.col("subsection.at") > F.col("section.at"))
    clause = inside & (F.col("clause.at") > F.greatest("section.at", "subsection.at"))
    subclause = clause & (F.col("subclause.at") > F.col("clause.at"))
    uid = {"section": F.concat(F.lit("sec-"), "section.name")}
    uid["subsection"] = F.concat(uid["section"], F.lit("-ss-"), "subsection.name")
    holder = F.when(sub, uid["subsection"]).when(inside, uid["section"])
    uid["clause"] = F.concat(holder, F.lit("-cl-"), "clause.name")
    uid["subclause"] = F.concat(uid["clause"], F.lit("-sc-"), "subclause.name")
    deepest = F.when(subclause, F.struct(F.col("subclause.at").alias("at"), uid["subclause"].alias("uid")))
    for held, k in ((clause, "clause"), (sub, "subsection"), (inside, "section")):
        deepest = deepest.when(held, F.struct(F.col(f"{k}.at").alias("at"), uid[k].alias("uid")))
    return rows.select(*lines.columns, "opens", "goes_on", F.col("chapter.name").alias("in_chapter"), "section", F.when(inside, uid["section"]).alias("in_section"), holder.alias("holder"), F.when(clause, uid["clause"]).alias("in_clause"), deepest.alias("deepest"))


def _refused(rows: DataFrame) -> DataFrame:
    """Section lines that are too short to replace the section of their number, by its text where they stand."""
    opens, chapter = F.col("opens"), F.col("kind") == "chapter"
    grown = F.when(opens, F.length("text")).when(F.col("goes_on") & (F.col("deepest.at") == F.col("section.at")), F.length("text") + 1).otherwise(0)
    after = rows.select("source_pdf", "pos", F.when(opens, F.col("name")).when(~chapter, F.col("section.name")).alias("name"), F.when(opens | chapter, F.col("pos")).otherwise(F.col("section.at")).alias("at"), grown.alias("grown"))
    sizes = after.where("name is not null").select("source_pdf", "name", "pos", F.sum("grown").over(W.partitionBy("source_pdf", "at").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)).alias("size"), F.lit(None).cast("int").alias("asked"))
    asked = rows.where("kind = 'section'").select("source_pdf", "name", "pos", F.lit(None).cast("long").alias("size"), F.length("text").alias("asked"))
    old = F.last("size", ignorenulls=True).over(W.partitionBy("source_pdf", "name").orderBy("pos", F.col("asked").isNull()).rowsBetween(*BEFORE))
    return sizes.unionByName(asked).withColumn("old", old).where((F.col("asked") <= REPLACES * F.col("old") + PLUS)).select("source_pdf", "pos")


def read_act(elements: DataFrame) -> DataFrame:
    """elements (source_pdf, path, type, content, page) -> lines with their kind and what is open there."""
    numbered, ranged = numbered_in_blocks(elements)
    lines = materialize(marked(numbered), "act-lines")
    release(ranged)
    refused = lines.select("source_pdf", "pos").limit(0)
    while True:
        rows = placed(lines, refused)
        after = materialize(_refused(rows), "act-refused")
        if after.exceptAll(refused).isEmpty() and refused.exceptAll(after).isEmpty():
            break
        refused = after
    out = materialize(rows, "act-placed")
    release(lines)
    return out


def _titled(rows: DataFrame) -> DataFrame:
    """Lines with ``names``: whether the heading names its chapter, and ``note``, the marginal note that waits there."""
    kind = F.col("kind")
    rows = rows.withColumn("own", F.when(kind == "chapter", F.col("name")).otherwise(F.col("in_chapter")))
    # a heading names its chapter if it is the first that could, before a section is first met there and before a title
    first = lambda df, name: df.groupBy("source_pdf", "own").agg(F.min("pos").alias(name))
    met = rows.where("opens").groupBy("source_pdf", "name").agg(F.min(F.struct("pos", "own")).alias("x")).select("source_pdf", "x.*")
    could = rows.where((kind == "heading") & F.col("own").isNotNull() & (F.col("text") == F.upper("text")) & (F.length("text") > 2)).select("source_pdf", "own", "pos")
    for df, name in ((met, "met"), (rows.where((kind == "chapter") & (F.length("title") > 0)), "titled")):
        ends = first(df, name).withColumnsRenamed({"source_pdf": "_source", "own": "_own"})
        could = could.join(ends, F.col("source_pdf").eqNullSafe(F.col("_source")) & (F.col("own") == F.col("_own")), "left").where(F.coalesce(F.col("pos") < F.col(name), F.lit(True))).select("source_pdf", "own", "pos")
    named = materialize(first(could, "_pos").select(F.col("source_pdf").alias("_source"), "_pos"), "act-named")
    rows = rows.join(named, F.col("source_pdf").eqNullSafe(F.col("_source")) & (F.col("pos") == F.col("_pos")), "left").withColumn("names", F.col("_pos").isNotNull()).drop("_source", "_pos")
    event = F.when((kind == "chapter") | F.col("opens"), F.struct("pos", F.lit(None).cast("string").alias("text"))).when((kind == "heading") & ~F.col("names") & ~F.col("text").rlike(NO_NOTE), F.struct("pos", "text"))
    return with_latest(rows, note=event).withColumn("note", F.col("note.text"))


def act_nodes(read: DataFrame, act_uid: str, act_title: str) -> DataFrame:
    """Nodes of lines as of ``read_act``; ``ord`` follows the lines."""
    rows = materialize(_titled(read), "act-titled")
    order, zero = F.col("pos") * 2, F.lit(0).cast("long")
    root = nodes(rows.select("source_pdf", F.lit(1).alias("page")).distinct(), "Act", uid=F.lit(act_uid), title=F.lit(act_title), text=F.lit(""), ord=zero)
    lines = rows.where("kind = 'chapter' or names")
    by_length = F.struct(F.length("said"), -F.col("pos"))
    chapters = lines.withColumn("said", F.when(F.col("names"), F.col("text")).otherwise(F.col("title"))).groupBy("source_pdf", F.col("own").alias("number")).agg(
        F.max_by("said", F.when(F.length("said") > 0, by_length)).alias("title"), *[F.min_by(c, F.when(F.col("kind") == "chapter", F.col("pos"))).alias(c) for c in ("text", "page", "pos")]
    )
    made = [root, nodes(chapters, "Chapter", uid=F.concat(F.lit("ch-"), "number"), parent=F.lit(act_uid), number="number", title=F.coalesce("title", F.lit("")), text="text", ord=order)]

    # sections: place and chapter of the first line, text of the last that opened it
    seen = F.array_sort(F.collect_list(F.struct("pos", "note", "title")))
    said = F.aggregate(seen, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | x["note"].isNotNull() | (F.length(x["title"]) > F.length(a)), F.coalesce(x["note"], x["title"])).otherwise(a))
    first, last = (lambda c: F.min_by(c, "pos")), (lambda c: F.max_by(c, "pos"))
    sections = rows.where("opens").groupBy("source_pdf", F.col("name").alias("number")).agg(said.alias("title"), first("in_chapter").alias("in_chapter"), first("text").alias("first_text"), last("text").alias("text"), last("page").alias("page"), F.max("pos").alias("at"), F.min("pos").alias("pos"))
    # sections before any chapter belong to the first real one, or to a preliminary one if there is none
    real = chapters.groupBy("source_pdf").agg(F.min_by("number", "pos").alias("first_chapter"))
    sections = sections.join(real, "source_pdf", "left")
    lost = sections.where("in_chapter is null and first_chapter is null").groupBy("source_pdf").agg(F.min_by("page", "pos").alias("page"), F.min("pos").alias("pos"))
    made.append(nodes(lost, "Chapter", uid=F.lit("ch-I"), parent=F.lit(act_uid), number=F.lit("I"), title=F.lit(PRELIMINARY), text=F.lit(""), ord=order - 1))
    more = appended(rows.where("goes_on"), F.col("deepest.at"))
    whole = lambda df: df.join(more, ["source_pdf", "at"], "left").withColumn("whole", F.concat_ws(" ", "text", "more"))
    made.append(nodes(whole(sections), "Section", uid=F.concat(F.lit("sec-"), "number"), parent=F.concat(F.lit("ch-"), F.coalesce("in_chapter", "first_chapter", F.lit("I"))), number="number", title="title", text="whole", ref_text="first_text", ord=order))

    part = lambda kind, parent: whole(rows.where((F.col("kind") == kind) & parent.isNotNull()).withColumn("at", F.col("pos")))
    section, holder, clause, deepest = F.col("in_section"), F.col("holder"), F.col("in_clause"), F.col("deepest.uid")
    made.append(nodes(part("subsection", section), "SubSection", uid=F.concat(section, F.lit("-ss-"), "name"), parent=section, number="name", text="whole", ref_text="text", ord=order))
    made.append(nodes(part("clause", holder), "Clause", uid=F.concat(holder, F.lit("-cl-"), "name"), parent=holder, node_label="name", text="whole", ref_text="text", ord=order))
    made.append(nodes(part("subclause", clause), "SubClause", uid=F.concat(clause, F.lit("-sc-"), "name"), parent=clause, node_label="name", text="whole", ref_text="text", ord=order))
    count = F.row_number().over(W.partitionBy("source_pdf", "section.at", "deepest.uid").orderBy("pos"))
    for kind, label, tag, extra in (("proviso", "Proviso", "-proviso-", {"proviso_type": T.proviso_type(F.col("text"))}), ("explanation", "Explanation", "-expl-", {"node_label": F.col("name")})):
        side = rows.where((F.col("kind") == kind) & deepest.isNotNull()).withColumn("k", count)
        made.append(nodes(side, label, uid=F.concat(deepest, F.lit(tag), F.col("k").cast("string")), parent=deepest, text="text", ord=order, **extra))
    made.append(nodes(rows.where((F.col("kind") == "definition") & holder.isNotNull()), "Definition", uid=F.concat(F.lit("def-"), T.slugify(F.col("name"))), parent=holder, term=F.lower("name"), text="text", ord=order))
    return union_all(made).select(FIELDS)


def act_warnings(read: DataFrame) -> DataFrame:
    """source_pdf, page, message of the lines that found no place."""
    lost = (
        F.when(F.col("goes_on") & F.col("deepest").isNull(), F.concat(F.lit("no open node: "), F.substring("text", 1, 80))).when((F.col("kind") == "subsection") & F.col("in_section").isNull(), "subsection without a section")
        .when((F.col("kind") == "clause") & F.col("holder").isNull() | (F.col("kind") == "subclause") & F.col("in_clause").isNull(), "clause without a parent")
        .when(F.col("kind").isin("proviso", "explanation") & F.col("deepest").isNull(), F.concat("kind", F.lit(" without a node"))).when((F.col("kind") == "definition") & F.col("holder").isNull(), "definition without a section")
    )
    return read.select("source_pdf", "page", "pos", lost.alias("message")).where("message is not null")


def parse_act(elements: DataFrame, uid: str = "act-companies-2013", title: str = "The Companies Act, 2013") -> DataFrame:
    """elements (source_pdf, path, type, content, page) -> nodes."""
    return act_nodes(read_act(elements), uid, title)
