"""The library's own operators over a graph of provisions made from the driver's tables.

Regions become acts, nations chapters, customers sections, orders subsections,
line items clauses, suppliers rules and parts definitions; their texts are phrased
from the rows' values, so that references, penalties and amendments are found in
them. The same SQL makes the nodes for the operators here and for their twins.
"""

from __future__ import annotations

import datetime
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import link, parse, report, resolve
from lexloom.operators.graph import union_all
from lexloom.operators.link import AMENDMENT_TYPES, CONTAINS
from lexloom.plans.registry import Registry, table
from lexloom.plans.templates import TEMPLATES, Graph
from lexloom.tables import materialize

reg = Registry()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
AS_OF = datetime.date(1999, 6, 30)

#: Portable SQL; {x} stands for a table.
NODES = """
select 'act-' || cast(r_regionkey as string) as uid, 'Act' as label, cast(null as string) as parent, cast(r_regionkey as string) as number, r_name as title, cast(null as string) as term, '' as text, cast(r_regionkey as bigint) as ord from {region}
union all select 'sch-' || cast(r_regionkey as string), 'Schedule', 'act-' || cast(r_regionkey as string), cast(r_regionkey as string), 'Schedule of ' || r_name, null, '', cast(r_regionkey as bigint) from {region}
union all select 'ruleset-' || cast(r_regionkey as string), 'RuleSet', null, null, 'Rules of ' || r_name, null, '', cast(r_regionkey as bigint) from {region}
union all select 'amend-' || cast(n_nationkey as string), 'AmendmentAct', null, null, 'Amendment by ' || n_name, null, '', cast(n_nationkey as bigint) from {nation}
union all select 'ch-' || cast(n_nationkey as string), 'Chapter', 'act-' || cast(n_regionkey as string), cast(n_nationkey as string), n_name, null, '', cast(n_nationkey as bigint) from {nation}
union all select 'sec-' || cast(c_custkey as string), 'Section', 'ch-' || cast(c_nationkey as string), cast(c_custkey as string), c_name, null,
  'Every ' || lower(c_mktsegment) || ' company is ' || case when c_acctbal < 0 then 'liable' else 'bound' end || ', subject to section ' || cast(c_custkey * 7 % 97 as string) || ', to keep it' || case when c_custkey % 5 = 0 then '; notwithstanding anything contained in section ' || cast(c_custkey % 11 as string) || ' it stands' else '' end
  || case when c_custkey % 9 = 0 then ' and section ' || cast(c_custkey % 13 as string) || ' shall mutatis mutandis apply' else '' end, c_custkey from {customer}
union all select 'sec-' || cast(o_custkey as string) || '-ss-' || cast(o_orderkey as string), 'SubSection', 'sec-' || cast(o_custkey as string), cast(o_orderkey as string), null, null,
  case o_orderstatus when 'F' then 'A person is punishable under section ' || cast(o_orderkey % 50 as string) || ' with a fine' when 'O' then 'As referred to in section ' || cast(o_orderkey % 40 as string) || ', read with section ' || cast(o_orderkey % 30 as string) else 'In the manner prescribed under section ' || cast(o_orderkey % 20 as string) || ' it is done' end, o_orderkey from {orders}
union all select distinct 'sec-' || cast(o_custkey as string) || '-ss-' || cast(o_orderkey as string) || '-cl-' || cast(l_linenumber as string), 'Clause', 'sec-' || cast(o_custkey as string) || '-ss-' || cast(o_orderkey as string), null, null, null, 'line ' || cast(l_linenumber as string), cast(l_linenumber as bigint) from {lineitem} join {orders} on l_orderkey = o_orderkey
union all select 'rule-' || cast(s_suppkey as string), 'Rule', 'ruleset-' || cast(s_suppkey % 5 as string), cast(s_suppkey as string), s_name || case when s_suppkey % 3 = 0 then ' in respect of section ' || cast(s_suppkey % 60 as string) else '' end, null,
  'In accordance with section ' || cast(s_suppkey % 45 as string) || ' the company shall file it in pursuance of section ' || cast(s_suppkey % 35 as string), s_suppkey from {supplier}
union all select distinct 'def-' || replace(p_name, ' ', '-'), 'Definition', 'sec-2', null, null, p_name, 'A ' || p_name || ' is a thing', cast(0 as bigint) from {part}"""
AMENDMENTS = """
select 'amend-' || cast(o_orderkey % 25 as string) as src, 'sec-' || cast(o_custkey as string) as dst, case o_orderkey % 40 when 0 then 'SUBSTITUTES' when 10 then 'INSERTS' when 20 then 'OMITS' else 'DECRIMINALIZES' end as rel_type,
  case o_orderkey % 40 when 20 then '' else ' firm' || cast(o_orderkey % 7 as string) end as new_text, case o_orderkey % 40 when 0 then ' company' when 10 then '' when 20 then ', to keep it' else ' bound' end as old_text, cast(o_orderdate as date) as effective_date, o_orderkey as seq from {orders} where o_orderkey % 10 = 0"""


def _clauses(spark: SparkSession, d: str) -> DataFrame:
    """The clauses of ``NODES``: told apart by their keys in the place of the join, before these become texts."""
    keys = ["o_custkey", "o_orderkey", "l_linenumber"]
    joined = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    known, empty = joined.where("o_custkey is not null").select(keys).distinct(), joined.where("o_custkey is null").select(F.col("o_custkey"), F.lit(None).cast("long").alias("o_orderkey"), "l_linenumber").distinct()
    parent, none = "'sec-' || cast(o_custkey as string) || '-ss-' || cast(o_orderkey as string)", "cast(null as string)"
    return known.unionByName(empty).selectExpr(f"{parent} || '-cl-' || cast(l_linenumber as string) as uid", "'Clause' as label", f"{parent} as parent", *[f"{none} as {c}" for c in ("number", "title", "term")], "'line ' || cast(l_linenumber as string) as text", "cast(l_linenumber as bigint) as ord")


def _plain_nodes(spark: SparkSession, d: str) -> DataFrame:
    others = [part for part in NODES.split("\nunion all ") if "{lineitem}" not in part]
    return spark.sql(" union all ".join(others), **{t: table(spark, d, t) for t in TABLES if t != "lineitem"}).unionByName(_clauses(spark, d))


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    return _plain_nodes(spark, d).withColumn("ref_text", F.col("text"))


def written_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes, written once; a text is written for both of its names."""
    return materialize(_plain_nodes(spark, d), "provisions").withColumn("ref_text", F.col("text"))


def amendments_of(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(AMENDMENTS, orders=table(spark, d, "orders"))


class Provisions(Graph):
    """The graph of provisions: a hop links the edges of its types alone, over nodes written once.

    Nothing is written for templates without hops; what several hops read is linked once.
    """

    def __init__(self, spark: SparkSession, d: str):
        vars(self).update(spark=spark, d=d, linked={})

    @cached_property
    def written(self) -> DataFrame:
        return written_nodes(self.spark, self.d)

    @property
    def nodes(self) -> DataFrame:
        return self.written if "written" in vars(self) else nodes_of(self.spark, self.d)

    @cached_property
    def edges(self) -> DataFrame:
        return materialize(link.link(self.written).unionByName(amendments_of(self.spark, self.d)), "provision-edges")

    def of_types(self, rels: tuple[str, ...]) -> DataFrame:
        amended = amendments_of(self.spark, self.d).where(F.col("rel_type").isin(list(rels)))
        linked = [r for r in rels if r not in AMENDMENT_TYPES]
        if linked and rels not in self.linked:
            self.linked[rels] = materialize(link.link(self.written, linked), "provision-edges")
        return self.linked[rels].unionByName(amended) if linked else amended

    def between(self, rels: tuple[str, ...], starts: DataFrame, targets: DataFrame | None) -> DataFrame:
        """Edges from some nodes: what else is in the graph isn't read for them, unless it is written already.

        A label's uids are its own here, so references from nodes are found at their rows.
        """
        amended = amendments_of(self.spark, self.d).where(F.col("rel_type").isin(list(rels)))
        linked = [r for r in rels if r not in AMENDMENT_TYPES]
        return materialize(link.link(self.nodes, linked, starts, targets), "provision-edges").unionByName(amended)

    def hop(self, rel: str | list[str], src: str = "src", dst: str = "dst", by: str = "src", starts: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
        rels = (rel,) if isinstance(rel, str) else tuple(rel)
        edges = self.of_types(rels) if starts is None else self.between(rels, starts, targets)
        return Graph(self.nodes, edges).hop(rel, src, dst, by)

    def children(self, parents: DataFrame, rel: str, label: str) -> DataFrame:
        """As of ``Graph``; the edges, of which there may be few, meet the nodes first."""
        edges = self.hop(rel, starts=parents).select(F.col("src").alias("parent_uid"), F.col("dst").alias("uid"))
        return edges.join(self.of(label).drop("parent"), "uid").join(parents.select(F.col("uid").alias("parent_uid")), "parent_uid")


def graph_of(spark: SparkSession, d: str) -> Graph:
    return Provisions(spark, d)


def _sql_references(column: str, patterns: list[tuple[str, str]]) -> str:
    each = [f"select uid as src, 'sec-' || unnest(regexp_extract_all({column}, '(?i){p}', 1)) as dst, '{kind}' as rel_type from nodes" for kind, p in patterns]
    return " union all ".join(each)


_BY_LABEL = " ".join(f"when '{k}' then '{v}'" for k, v in CONTAINS.items())
_BY_HAND = " ".join(f"when '{k}' then '{v}'" for k, v in parse.DERIVED_BY_HAND.items())
_FIRST = f"coalesce(nullif(regexp_extract(coalesce(title, ''), '{parse.DERIVED}', 1), ''), nullif(regexp_extract(text, '{parse.DERIVED}', 1), ''))"
#: Nodes, links, all edges and what hangs on them as common tables of a twin, each evaluated once.
WITH_NODES = "with recursive nodes as materialized (" + NODES.format(**{t: t for t in TABLES}) + ")"
_COMMON = {
    "amendments": f"{AMENDMENTS.format(orders='orders')}",
    "found": f"""select parent as src, uid as dst, case label {_BY_LABEL} end as rel_type from nodes where parent is not null union all {_sql_references("text", parse.REFERENCES)} union all {_sql_references("text", parse.DETECTED)}
  union all select uid, 'sec-' || {_FIRST}, 'DERIVED_RULE' from nodes where label = 'Rule' and {_FIRST} is not null union all select uid, case uid {_BY_HAND} end, 'DERIVED_RULE' from nodes where label = 'Rule' and uid in ({", ".join(f"'{k}'" for k in parse.DERIVED_BY_HAND)})""",
    "links": "select distinct src, dst, rel_type from found where rel_type is not null and src in (select uid from nodes) and dst in (select uid from nodes)",
    "edges": "select src, dst, rel_type, cast(null as varchar) as new_text, cast(null as varchar) as old_text, cast(null as date) as effective_date, 0 as seq from links union all select * from amendments",
    "hits": f"select e.*, s.number, s.title, a.title as amendment_title from edges e join nodes s on s.uid = e.dst and s.label = 'Section' join nodes a on a.uid = e.src and a.label = 'AmendmentAct' where rel_type in {AMENDMENT_TYPES}",
    "subs": "select p.uid as top, c.* from edges e join nodes p on p.uid = e.src and p.label = 'Section' join nodes c on c.uid = e.dst and c.label = 'SubSection' where rel_type = 'HAS_SUBSECTION'",
}


def twin(sql: str) -> str:
    """The SQL after the common tables that it uses, directly or through others."""
    used, text = [], sql
    for name in reversed(_COMMON):
        if re.search(rf"\b{name}\b", text):
            used.append(name)
            text += f" {_COMMON[name]}"
    return WITH_NODES + "".join(f", {name} as materialized ({_COMMON[name]})" for name in reversed(used)) + " " + sql


def _joined(array: str, *fields: str):
    """Structs of an array as text, so that results have plain columns."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", *[x[f] for f in fields]) if fields else x), "|")


def _template(name: str, sql: str, shape=None, **slots):
    """Registers ``ask_<name>``: the template over the graph of provisions."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        made = TEMPLATES[name](graph_of(spark, d), **slots)
        return shape(made) if shape else made

    query.__name__ = f"ask_{name}"
    reg.query(twin(sql))(query)


PENAL = "regexp_matches(text, 'penalty|liable|fine')"
_template("section_by_number", "select uid, title, text from nodes where label = 'Section' and number = '7'", n="7")
_template("definitions_like", "select uid, term, text from nodes where label = 'Definition' and contains(term, 'ring')", term="ring")
_template("rule_by_number", "select uid, title, text from nodes where label = 'Rule' and number = '5'", n="5")
_template("subsections_of", "select uid, number, text from subs where top = 'sec-7'", n="7")
_template("meaning_of", "select uid, term as name, text from nodes where label = 'Definition' and contains(lower(term), 'in') union select uid, number, text from subs where top = 'sec-2' and contains(lower(text), 'in')", term="In")
_template("section_with_subsections", "select n.uid, n.title, n.text, coalesce((select string_agg(text, '|' order by ord) from subs where top = n.uid), '') as subsections from nodes n where n.label = 'Section' and n.number = '7'", lambda df: df.withColumn("subsections", _joined("subsections")), n="7")
_template("all_definitions", "select uid, term, text from nodes where label = 'Definition'")
_template("schedule_by_number", "select uid, title, text from nodes where label = 'Schedule' and number = '1'", n="1")
_template("amendments_of", "select src as amendment_uid, amendment_title, rel_type, old_text, new_text, effective_date from hits where number = '9'", n="9")
_template("sections_changed", "select dst as uid, number, title, src as amendment_uid, new_text, effective_date from hits where rel_type = 'OMITS'", rel="OMITS")
_template("changed_by", "select dst as uid, number, title, rel_type from hits where src = 'amend-5'", amendment_uid="amend-5", limit=None)
_template("section_with_amendments", "select uid, title, text, (select string_agg(text, '|' order by text) from (select distinct text from subs where top = n.uid)) as subsections, (select string_agg(rel_type || ':' || new_text || ':' || old_text, '|' order by rel_type, new_text, old_text) from (select distinct rel_type, new_text, old_text from hits where dst = n.uid)) as amendments from nodes n where label = 'Section' and number = '7'", lambda df: df.withColumn("subsections", _joined("subsections")).withColumn("amendments", _joined("amendments", "type", "new_text", "old_text")), n="7")
_template("amended_sections", "select dst as uid, number, title, rel_type, src as amendment_uid, effective_date from hits", limit=None)
_template("amendments_in_chapter", "select dst as uid, h.title, h.rel_type, h.src as amendment_uid from hits h join nodes n on n.uid = h.dst where n.parent = 'ch-3'", chapter="3")
_template("references_to", "select n.uid, n.label as type, e.rel_type, n.text from edges e join nodes n on n.uid = e.src where e.dst = 'sec-7' and e.rel_type = 'REFERS_TO'", n="7")
_template("subject_to_of", "select e.src as uid, e.dst as target_uid, t.title from edges e join nodes t on t.uid = e.dst where e.rel_type = 'SUBJECT_TO' and e.src in (select 'sec-7' union all select uid from subs where top = 'sec-7')", n="7")
_template("notwithstanding_pairs", "select e.src as uid, a.label as source_type, e.dst as target_uid, b.label as target_type from edges e join nodes a on a.uid = e.src join nodes b on b.uid = e.dst where e.rel_type = 'NOTWITHSTANDING'")
_template("rules_for", "select n.uid, n.number, n.title, n.text, e.rel_type from edges e join nodes n on n.uid = e.src and n.label = 'Rule' where e.dst = 'sec-7' and e.rel_type in ('REFERS_TO', 'PRESCRIBES_FOR', 'DERIVED_RULE')", n="7")
_template("chapters_without_rules", "select c.uid, c.number, c.title, count(*) as sections from nodes c join nodes s on s.parent = c.uid and s.label = 'Section' where c.label = 'Chapter' and s.uid not in (select e.dst from edges e join nodes r on r.uid = e.src and r.label = 'Rule' where e.rel_type in ('REFERS_TO', 'PRESCRIBES_FOR', 'DERIVED_RULE')) group by c.uid, c.number, c.title")
_template("penalty_bundle", "select uid, title, text, (select string_agg(uid || ':' || text, '|' order by uid, text) from subs where top = 'sec-7') as subsections, (select string_agg(c.uid || ':' || c.text, '|' order by c.uid, c.text) from subs s join nodes c on c.parent = s.uid and c.label = 'Clause' where s.top = 'sec-7') as clauses, (select string_agg(uid, '|' order by uid) from (select distinct r.uid from edges e join nodes r on r.uid = e.src and r.label = 'Rule' where e.dst = 'sec-7' and e.rel_type in ('REFERS_TO', 'PRESCRIBES_FOR', 'DERIVED_RULE'))) as rules from nodes where uid = 'sec-7'", lambda df: df.select("uid", "title", "text", _joined("subsections", "uid", "text").alias("subsections"), _joined("clauses", "uid", "text").alias("clauses"), _joined("rules").alias("rules")), n="7")
_template("penal_subsections", f"select uid, title, text, (select string_agg(text, '|' order by text) from (select distinct text from subs where top = 'sec-7' and {PENAL})) as penalties from nodes where uid = 'sec-7'", lambda df: df.withColumn("penalties", _joined("penalties")), n="7")
_template("liabilities", f"select uid, number, title, (select string_agg(s.text, '|' order by s.text) from subs s where s.top = n.uid and {PENAL.replace('text', 's.text')}) as penalties from nodes n where label = 'Section' and contains(text, 'liable')", lambda df: df.withColumn("penalties", _joined("penalties")))
_template("sections_of_chapter", "select uid, number, title from nodes where label = 'Section' and parent = 'ch-3'", chapter="3")
_template("sections_of_chapters_like", "select s.uid, s.number, s.title from nodes s join nodes c on c.uid = s.parent where s.label = 'Section' and contains(upper(c.title), 'NATION_1')", words="nation_1")
_template("count_sections", "select count(*) as sections from nodes where label = 'Section'")
_template("count_chapters", "select count(*) as chapters from nodes where label = 'Chapter'")
_template("chapters_with_counts", "select c.uid, c.number, c.title, (select count(*) from nodes s where s.parent = c.uid and s.label = 'Section') as sections from nodes c where c.label = 'Chapter'", limit=None)
_template("chapters", "select uid, number, title from nodes where label = 'Chapter'")
_template("sections_mentioning", "select uid, number, title, text from nodes where label = 'Section' and contains(text, 'machinery')", words="machinery", limit=None)
_template("rules_preview", "select uid, number, title, substr(text, 1, 150) as preview from nodes where label = 'Rule'", limit=None)
_template("label_counts", "select label, count(*) as count from nodes group by label")
_template("rel_counts", "select rel_type, count(*) as count from edges group by rel_type")


@reg.query(twin("select src, dst, rel_type from links"))
def linked_edges(spark: SparkSession, d: str) -> DataFrame:
    return link.link(written_nodes(spark, d)).select("src", "dst", "rel_type")  # read by each kind of link


@reg.query(WITH_NODES + " select uid, label, case label " + _BY_LABEL + " end as rel_type, parent from nodes where parent is not null")
def structural_links(spark: SparkSession, d: str) -> DataFrame:
    nodes = nodes_of(spark, d)
    return link.structural_edges(nodes).select(F.col("dst").alias("uid"), "rel_type", F.col("src").alias("parent")).join(nodes.select("uid", "label").distinct(), "uid")


@reg.query(WITH_NODES + f", found as ({_sql_references('text', parse.REFERENCES)}) select src, dst, rel_type, count(*) as n from found group by all")
def phrases_by_type(spark: SparkSession, d: str) -> DataFrame:
    each = nodes_of(spark, d).select(F.col("uid").alias("src"), F.explode(parse.cross_references(F.col("text"))).alias("r"))
    return each.groupBy("src", F.regexp_replace("r.target_pattern", "section ", "sec-").alias("dst"), F.col("r.ref_type").alias("rel_type")).agg(F.count("*").alias("n"))


_FOLD = """, ordered as (select dst, rel_type, new_text, old_text, row_number() over (partition by dst order by effective_date, seq) as k from amendments where effective_date <= {when}),
state as (select uid, text as txt, case when exists (select 1 from ordered where dst = uid) then 'amended' else 'original' end as status, cast(0 as bigint) as k from nodes where label = 'Section'
  union all select s.uid, case when o.rel_type in ('SUBSTITUTES', 'DECRIMINALIZES') and o.old_text <> '' then replace(s.txt, o.old_text, o.new_text) when o.rel_type = 'INSERTS' then s.txt || o.new_text when o.rel_type = 'OMITS' and o.old_text <> '' then replace(s.txt, o.old_text, '') else s.txt end,
    case when o.rel_type = 'OMITS' then 'omitted' else s.status end, o.k from state s join ordered o on o.dst = s.uid and o.k = s.k + 1)
select uid, txt as current_text, status, k as changes from state qualify row_number() over (partition by uid order by k desc) = 1"""


def _states(spark: SparkSession, d: str, as_of: datetime.date | None) -> DataFrame:
    found = resolve.effective_states(nodes_of(spark, d), amendments_of(spark, d), as_of)
    return found.select("uid", "state.current_text", "state.status", F.size("state.amendment_chain").cast("long").alias("changes"))


@reg.query(twin(_FOLD.format(when="current_date")))
def effective_texts(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d, None)


@reg.query(twin(_FOLD.format(when=f"date '{AS_OF}'")))
def effective_texts_as_of(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d, AS_OF)


_KINDS = ("Chapter", "Section", "SubSection", "Clause", "SubClause", "Proviso", "Explanation", "Definition", "Rule", "Form")


@reg.query(WITH_NODES + " select " + ", ".join(f"count(*) filter (where label = '{k}') as {k}" for k in _KINDS) + ", least(round(count(*) filter (where label = 'Section') / 470.0 * 100, 1), 100.0)::double as coverage_pct, array_to_string(list_filter([case when count(*) filter (where label = 'Section') < 400 then 'few sections' end, case when count(*) filter (where label = 'Definition') < 50 then 'few definitions' end, case when count(*) filter (where label = 'Proviso') = 0 then 'no provisos' end, case when count(*) filter (where label = 'Rule') < 30 then 'few rules' end], lambda x: x is not null), '|') as warnings from nodes")
def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    return report.parse_report(nodes_of(spark, d)).withColumn("warnings", _joined("warnings"))


@reg.query(twin("select 'orphans' as check, count(*) as n from nodes where label not in ('Act', 'RuleSet', 'AmendmentAct') and uid not in (select dst from edges) union all select 'broken_edges', count(*) from edges where dst not in (select uid from nodes) union all select 'repeated_uids', count(*) from (select label, uid from nodes group by label, uid having count(*) > 1)"))
def integrity_checks(spark: SparkSession, d: str) -> DataFrame:
    nodes = written_nodes(spark, d)
    return report.integrity(nodes, link.link(nodes).unionByName(amendments_of(spark, d)))


@reg.query(twin("select (select count(*) from nodes) as nodes, (select count(*) from found where rel_type is not null) as edges_attempted, (select count(*) from links) as edges_created"))
def load_summary(spark: SparkSession, d: str) -> DataFrame:
    nodes = written_nodes(spark, d)
    attempted = union_all([link.contained(nodes).select("src", "dst"), link.references(nodes).select(F.col("uid").alias("src"), F.col("n").alias("dst")), link.derived(nodes).select("src", "dst")])
    return report.load_summary(nodes, attempted, link.link(nodes))


@reg.query(WITH_NODES + ", tree as (select uid, label, parent, 0 as depth from nodes where parent is null union all select n.uid, n.label, n.parent, t.depth + 1 from nodes n join tree t on n.parent = t.uid) select label, depth, count(*) as nodes from tree group by label, depth")
def depths_by_label(spark: SparkSession, d: str) -> DataFrame:
    return report.depths(nodes_of(spark, d)).groupBy("label", "depth").agg(F.count("*").alias("nodes"))


@reg.query(twin("select severity, gap, found from (select 'CRITICAL' as severity, 'sections are missing' as gap, greatest(2000 - count(*) filter (where label = 'Section'), 0) as found from nodes union all select 'MEDIUM', 'sections are short', count(*) filter (where label = 'Section' and length(text) < 50) from nodes union all select 'LOW', 'texts are oversized', count(*) filter (where length(text) > 5000) from nodes union all select 'HIGH', 'rules are empty', count(*) filter (where label = 'Rule' and length(text) = 0) from nodes union all select 'HIGH', 'amendments have no new text', count(*) filter (where new_text = '') from amendments) where found > 0"))
def audit_gaps(spark: SparkSession, d: str) -> DataFrame:
    return report.gaps(nodes_of(spark, d), amendments_of(spark, d), 2000)


_TEXTS = "case o_orderkey % 5 when 0 then 'In the said Act, in section ' || cast(o_orderkey % 90 as string) || ', the words shall be substituted' when 1 then 'In the principal Act, in section ' || cast(o_orderkey % 80 as string) || ', it shall be inserted' when 2 then 'In the Companies Act, 2013, in section ' || cast(o_orderkey % 70 as string) || ', it shall be omitted' when 3 then 'In the said Act, in section 9, a civil penalty shall be substituted' else 'Nothing is said' end"


def _orders_as_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "orders").select(F.expr("concat('o', cast(o_orderkey % 3 as string))").alias("source_pdf"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"), F.lit("paragraph").alias("type"), F.expr(_TEXTS).alias("content"), F.lit(1).alias("page"))
    return parse.parse_amendments(lines, "amend-x")


_PARSED = f"select lpad(cast(o_orderkey as varchar), 12, '0') as path, 'section ' || case o_orderkey % 5 when 0 then o_orderkey % 90 when 1 then o_orderkey % 80 when 2 then o_orderkey % 70 else 9 end as target_section, case o_orderkey % 5 when 0 then 'SUBSTITUTES' when 1 then 'INSERTS' when 2 then 'OMITS' else 'DECRIMINALIZES' end as amendment_type, {_TEXTS.replace('as string', 'as varchar')} as raw_text from orders where o_orderkey % 5 < 4"


@reg.query(_PARSED)
def parsed_amendments(spark: SparkSession, d: str) -> DataFrame:
    return _orders_as_lines(spark, d).select("path", "target_section", "amendment_type", "raw_text")


@reg.query(f"select count(*) as amendments, 100.0::double as valid_type_pct, cast(0 as bigint) as with_text, cast(0 as bigint) as warned from ({_PARSED})")
def amendment_report(spark: SparkSession, d: str) -> DataFrame:
    return report.amendment_report(_orders_as_lines(spark, d)).drop("warnings")


@reg.query(f"select src, dst, rel_type, cast('2026-01-01' as date) as effective_date from (select 'amend-x' as src, replace(target_section, 'section ', 'sec-') as dst, amendment_type as rel_type from ({_PARSED}))")
def amendment_links(spark: SparkSession, d: str) -> DataFrame:
    made, _ = link.amendment_edges(_orders_as_lines(spark, d), 2026)
    return made.select("src", "dst", "rel_type", "effective_date")


@reg.query(WITH_NODES + " select count(*) filter (where label = 'Rule') as rules, cast(0 as bigint) as forms, 100.0::double as titled_pct from nodes")
def rules_report(spark: SparkSession, d: str) -> DataFrame:
    return report.rules_report(nodes_of(spark, d))


@reg.query(WITH_NODES + " select range as id from range(1, 3001) where range not in (select cast(number as bigint) from nodes where label = 'Section')")
def absent_sections(spark: SparkSession, d: str) -> DataFrame:
    return report.missing_sections(nodes_of(spark, d), 3000)


@reg.query("select 'def-' || replace(p_name, ' ', '-') as uid, 'sec-2-ss-' || p_partkey as parent, p_name as term from part where p_partkey % 3 > 0")
def mined_definitions(spark: SparkSession, d: str) -> DataFrame:
    uid, said = "concat('sec-2-ss-', p_partkey)", "concat('(', p_partkey, ') \"', p_name, '\" means ', p_type)"
    none = {c: F.lit(None).cast("string") for c in parse.FIELDS}
    part = table(spark, d, "part")
    subs = part.select(*[{"uid": F.expr(uid), "label": F.lit("SubSection"), "parent": F.lit("sec-2"), "text": F.expr(said)}.get(c, none[c]).alias(c) for c in parse.FIELDS])
    known = part.where("p_partkey % 3 = 0").select(*[{"uid": F.lit("def"), "label": F.lit("Definition"), "parent": F.expr(uid), "term": F.col("p_name")}.get(c, none[c]).alias(c) for c in parse.FIELDS])
    return parse.mine_definitions(subs.unionByName(known)).select("uid", "parent", "term")


@reg.query("select coalesce(event_type, '') as category, count(*) as n, avg(case when value > 1 then 1.0 else 0.0 end) as ok_rate, list_sort(list(value) filter (where value > 1))[1 + cast(floor(count(*) filter (where value > 1) * 0.5) as bigint)] as p50_ms, list_sort(list(value) filter (where value > 1))[1 + cast(floor(count(*) filter (where value > 1) * 0.9) as bigint)] as p90_ms from (select event_type, value from events union all select null, value from events) group by 1")
def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").select(F.col("event_type").alias("category"), F.when(F.col("value") > 1, "ok").otherwise("late").alias("status"), F.lit(True).alias("answer_ok"), F.col("value").alias("latency_ms"))
    return report.evaluation(runs).select(F.coalesce("category", F.lit("")).alias("category"), "n", "ok_rate", "p50_ms", "p90_ms")


ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI", "XVII", "XVIII", "XIX", "XX", "XXI", "XXII", "XXIII", "XXIV", "XXV"]
_ROMAN = "case n_nationkey " + " ".join(f"when {k} then '{r}'" for k, r in enumerate(ROMAN)) + " end"


def act_lines(spark: SparkSession, d: str) -> DataFrame:
    """An act for each region: a table of contents, then nations as chapters, customers as sections, orders as their parts.

    Sections belong to the first chapter, since they are first met in the contents, before any chapter.
    """
    nation, customer, orders = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    at = lambda *parts: F.concat(*[F.lpad(F.col(p).cast("string"), 12, "0") if isinstance(p, str) else F.lit(str(p)) for p in parts])
    line = lambda df, path, kind, text: df.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source_pdf"), path.alias("path"), F.lit(kind).alias("type"), text.alias("content"), F.lit(1).alias("page"))
    number = F.col("c_custkey").cast("string")
    of_order = orders.join(placed, F.col("o_custkey") == F.col("c_custkey"))
    said = F.expr("case o_orderstatus when 'F' then concat('Provided that ', o_orderpriority) when 'O' then concat('(', o_orderkey, ') ', o_orderpriority) else concat('and ', o_orderpriority) end")
    return union_all([
        line(placed, at(0, "c_custkey"), "paragraph", F.concat(number, F.lit(". "), "c_name", F.lit("."))),
        line(nation, at(1, "n_nationkey", 0), "heading", F.concat(F.lit("CHAPTER "), F.expr(_ROMAN))), line(nation, at(1, "n_nationkey", 1), "heading", F.upper("n_name")),
        line(placed, at(1, "n_nationkey", 2, "c_custkey", 0), "paragraph", F.concat(number, F.lit(". "), "c_name", F.lit(".--Every company of the kind of "), "c_mktsegment", F.lit(" shall keep all that it has in the order that this section lays down"))),
        line(of_order, at(1, "n_nationkey", 2, "c_custkey", 1, "o_orderkey"), "paragraph", said),
    ])


_ACT = """with marked as (select o.*, 'r' || n_regionkey as src, max(case when o_orderstatus = 'O' then o_orderkey end) over (partition by n_regionkey, o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding) as held from orders o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
placed as (select *, 'sec-' || o_custkey || coalesce('-ss-' || held, '') as holder from marked),
more as (select src, holder, string_agg('and ' || o_orderpriority, ' ' order by o_orderkey) as more from placed where o_orderstatus = 'P' group by src, holder)
select m.src as source_pdf, 'sec-' || c_custkey as uid, 'Section' as label, 'ch-' || @roman as parent, c_name as title, c_custkey || '. ' || c_name || '.--Every company of the kind of ' || c_mktsegment || ' shall keep all that it has in the order that this section lays down' || coalesce(' ' || more.more, '') as text
  from (select customer.*, (select min(f.n_nationkey) from nation f where f.n_regionkey = nation.n_regionkey) as n_nationkey, 'r' || n_regionkey as src from customer join nation on c_nationkey = nation.n_nationkey) m left join more on more.src = m.src and more.holder = 'sec-' || c_custkey
union all select p.src, 'sec-' || o_custkey || '-ss-' || o_orderkey, 'SubSection', 'sec-' || o_custkey, null, '(' || o_orderkey || ') ' || o_orderpriority || coalesce(' ' || more.more, '') from placed p left join more on more.src = p.src and more.holder = 'sec-' || o_custkey || '-ss-' || o_orderkey where o_orderstatus = 'O'
union all select src, holder || '-proviso-' || row_number() over (partition by src, holder order by o_orderkey), 'Proviso', holder, null, 'Provided that ' || o_orderpriority from placed where o_orderstatus = 'F'
union all select 'r' || n_regionkey, 'ch-' || @roman, 'Chapter', 'act-x', upper(n_name), 'CHAPTER ' || @roman from nation
union all select distinct 'r' || n_regionkey, 'act-x', 'Act', null, 'X', '' from nation""".replace("@roman", _ROMAN)


@reg.query(_ACT)
def parsed_act(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse_act(act_lines(spark, d), "act-x", "X").select("source_pdf", "uid", "label", "parent", "title", "text")


_RULES = """with lines as (select 'r' || (s_suppkey % 3) as src, s_suppkey, s_name, 'rule' as kind, cast(s_suppkey % 20 as varchar) as num from supplier),
k as (select *, row_number() over (partition by src order by s_suppkey) - 1 as before, row_number() over (partition by src, num order by s_suppkey) as nth from lines), named as (select *, num || case when nth > 1 then '-dup-' || before else '' end as name from k)
select src as source_pdf, 'rule-' || name as uid, 'Rule' as label, name as number, 'Filing of ' || s_name as title, 'The company shall file ' || s_name || case when s_suppkey % 4 = 0 then ' [TABLE CONTENT]' else '' end as text, cast(null as varchar) as associated_rule from named
union all select src, 'form-abc-' || s_suppkey, 'Form', null, 'Form No. ABC-' || s_suppkey, 'Name of the company', name from named where s_suppkey % 2 = 0
union all select distinct src, 'ruleset-x', 'RuleSet', null, 'X', '', null from lines"""


@reg.query(_RULES)
def parsed_rules(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    src, at = F.concat(F.lit("r"), (F.col("s_suppkey") % 3).cast("string")), lambda k: F.concat(F.lpad(F.col("s_suppkey").cast("string"), 12, "0"), F.lit(str(k)))
    line = lambda df, k, kind, text: df.select(src.alias("source_pdf"), at(k).alias("path"), F.lit(kind).alias("type"), text.alias("content"), F.lit(1).alias("page"))
    even = s.where("s_suppkey % 2 = 0")
    lines = union_all([
        line(s, 0, "heading", F.concat(F.lit("Rule "), (F.col("s_suppkey") % 20).cast("string"), F.lit(". Filing of "), "s_name", F.lit("."))), line(s, 1, "paragraph", F.concat(F.lit("The company shall file "), "s_name")), line(s, 2, "paragraph", F.lit("कंपनी अधिनियम के नियम")),
        line(s.where("s_suppkey % 4 = 0"), 3, "table", F.lit("cells")), line(even, 4, "heading", F.concat(F.lit("Form No. ABC-"), F.col("s_suppkey").cast("string"))), line(even, 5, "paragraph", F.lit("Name of the company")),
    ])
    return parse.parse_rules(lines, "X").select("source_pdf", "uid", "label", "number", "title", "text", "associated_rule")


@reg.query("select cast(conv_id as varchar) as source_pdf, role as type, text as content, cast(turn as integer) as page from (select conv_id, turn, 'paragraph' as role, text from conversations where text <> '' union all select distinct conv_id, -1, 'heading', 'talk' from conversations)")
def flattened_elements(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as element trees: a heading, then a list whose items are the turns."""
    talk = table(spark, d, "conversations")
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(F.lit("list item").alias("type"), x["text"].alias("content"), x["turn"].alias("page number")))
    kids = F.concat(F.lit('{"kids": [{"type": "heading", "content": "talk", "page number": -1}, {"type": "header", "content": "no"}, {"type": "list", "list items": '), F.to_json(items), F.lit("}]}"))
    raw = talk.groupBy(F.col("conv_id").cast("string").alias("source_pdf")).agg(kids.alias("json"))
    return parse.flatten_elements(raw).select("source_pdf", "type", "content", "page")


