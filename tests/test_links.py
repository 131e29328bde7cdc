import duckdb
import pytest

from lexloom.operators import link, report
from lexloom.plans import catalogue
from lexloom.plans import provision_queries as provisions
from lexloom.plans.templates import TEMPLATES, Graph

NODE = "uid string, label string, parent string, title string, text string, ref_text string"
N = lambda uid, label, parent=None, text="", title=None: (uid, label, parent, title, text, text)


@pytest.fixture
def tables(spark, tmp_path):
    """The tables of sf0.001 with odd rows: repeated customers and suppliers, orders without a customer, of one that is absent, lines without a number."""
    duck = duckdb.connect()
    for name in provisions.TABLES:
        duck.sql(f"create table {name} as select * from '/root/testdata/sf0.001/{name}.parquet'")
    duck.sql("insert into customer select * from customer where c_custkey < 20")
    duck.sql("insert into supplier select * from supplier where s_suppkey < 4")
    duck.sql("update orders set o_custkey = null where o_orderkey % 50 = 1")
    duck.sql("update orders set o_custkey = 999999 where o_orderkey % 50 = 2")
    duck.sql("insert into orders select * from orders where o_orderkey < 9")
    duck.sql("update lineitem set l_linenumber = null where l_orderkey % 40 = 3")
    for name in provisions.TABLES:
        duck.sql(f"copy {name} to '{tmp_path}/{name}.parquet' (format parquet)")
    return duck, str(tmp_path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_clauses_are_those_of_the_sql(spark, tables):
    duck, d = tables
    found = provisions.nodes_of(spark, d).drop("ref_text")
    said = spark.sql(provisions.NODES, **{t: spark.read.parquet(f"{d}/{t}.parquet") for t in provisions.TABLES})
    assert found.columns == said.columns and rows(found) == rows(said)
    assert found.where("label = 'Clause' and parent is null").count() > 0 and found.where("label = 'Clause' and parent is not null and uid is null").count() > 0


@pytest.mark.parametrize("name", ["linked_edges", "load_summary"])
def test_links_of_odd_tables_equal_the_sql(spark, tables, name):
    duck, d = tables
    sql = catalogue.oracle_sql()[name]
    found = catalogue.queries()[name](spark, d)
    assert rows(found) == sorted(duck.sql(sql).fetchall(), key=repr)


def test_ends_are_looked_up_in_one_shuffle_and_edges_stay(spark, monkeypatch):
    nodes = spark.createDataFrame([
        N("a", "Act"), N("sec-1", "Section", "a", "under section 2, as mentioned in section 2 and under section 9"), N("sec-1", "Section", "a", "under section 2"), N("sec-2", "Section", "a", "under section 1x"),
        N("x", "Clause", "gone"), N("sec-2", "Rule", "sec-1", "under section 1"), N(None, "Clause", "a", "under section 1"), N("y", "Odd", "a"),
    ], NODE)
    made = link.link(nodes)
    got = [tuple(r) for r in made.select("src", "rel_type", "dst").collect()]
    want = [("a", "HAS_SECTION", "sec-1"), ("a", "HAS_SECTION", "sec-2"), ("sec-1", "HAS_RULE", "sec-2"), ("sec-1", "REFERS_TO", "sec-2"), ("sec-2", "REFERS_TO", "sec-1"), ("sec-2", "DERIVED_RULE", "sec-1")]
    assert sorted(got) == sorted(want)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "nodes" not in plan  # phrases are looked for once


def test_integrity_counts_null_and_repeated_ends(spark):
    nodes = spark.createDataFrame([N("a", "Act"), N("b", "Section", "a"), N("b", "Section", "a"), N("b", "Rule"), N(None, "Clause"), N(None, "Clause"), N("lone", "Clause"), N("lone", "Rule"), N("z", None)], NODE)
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "gone"), ("a", "gone"), ("a", None)], "src string, dst string")
    found = {r["check"]: r["n"] for r in report.integrity(nodes, edges).collect()}
    assert found == {"orphans": 4, "broken_edges": 3, "repeated_uids": 2}
    empty = {r["check"]: r["n"] for r in report.integrity(nodes.limit(0), edges.limit(0)).collect()}
    assert empty == {"orphans": 0, "broken_edges": 0, "repeated_uids": 0}


@pytest.mark.parametrize("name,slots", [("section_with_subsections", {"n": "7"}), ("chapters_without_rules", {})])
def test_hops_from_some_nodes_read_what_leads_from_them(spark, tables, monkeypatch, name, slots):
    duck, d = tables
    nodes, written = provisions.nodes_of(spark, d), []
    whole = TEMPLATES[name](Graph(nodes, link.link(nodes)), **slots)
    keep = provisions.materialize
    monkeypatch.setattr(provisions, "materialize", lambda df, name: written.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or keep(df, name))
    found = TEMPLATES[name](provisions.graph_of(spark, d), **slots)
    assert rows(found.select(whole.columns)) == rows(whole) != []
    assert {n for n, _ in written} == {"provision-edges"} and not any("l_linenumber" in plan for _, plan in written)
    assert "l_linenumber" not in found._jdf.queryExecution().optimizedPlan().toString()
