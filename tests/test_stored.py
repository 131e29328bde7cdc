import uuid

import duckdb
import pytest

from lexloom.operators import link
from lexloom.plans import catalogue, stored
from lexloom.plans import provision_queries as provisions
from lexloom.plans.templates import TEMPLATES, Graph

SF = "/root/testdata/sf0.001"
ASKED = {"amended_sections": {"limit": None}, "sections_changed": {"rel": "OMITS"}, "references_to": {"n": "7"}, "rules_for": {"n": "7"}, "chapters_without_rules": {}, "liabilities": {}, "notwithstanding_pairs": {}, "sections_of_chapter": {"chapter": "3"}, "subsections_of": {"n": "7"}, "penalty_bundle": {"n": "7"}, "section_with_amendments": {"n": "9"}}


@pytest.fixture(scope="module")
def graphs(spark, tmp_path_factory):
    made = provisions.graph_of(spark, SF)
    name = f"g{uuid.uuid4().hex}"
    kept = stored.store(made, name, str(tmp_path_factory.mktemp("stored")), 8)
    yield made, kept
    for side, _ in stored.SIDES:
        spark.sql(f"drop table {name}_{side}")


def moved(plan):
    """Exchanges of a plan whose rows come straight from a scan of edges."""
    lines = [(len(x) - len(x.lstrip(" :+-*()0123456789")), x) for x in plan.split("\n") if x.strip()]
    out = []
    for k, (depth, line) in enumerate(lines):
        if " Exchange" in f" {line.lstrip(' :+-')}" and "Broadcast" not in line:
            for below, other in lines[k + 1 :]:
                if below <= depth or "Join" in other or "Aggregate" in other:
                    break
                if "FileScan" in other and "edges_by" in other:
                    out.append(line.strip())
    return out


def plan_of(spark, df):
    """The plan without broadcasts and without re-planning; plans are made when they are first asked for."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ASKED)
def test_hops_move_no_edges(spark, graphs, name):
    plain, kept = graphs
    ask = TEMPLATES[name]
    assert sorted(map(str, ask(kept, **ASKED[name]).collect())) == sorted(map(str, ask(plain, **ASKED[name]).collect()))
    plan = plan_of(spark, ask(kept, **ASKED[name]))
    assert "edges_by" in plan and not moved(plan)


def test_hot_ends_stay_without_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "FEW", 10)
    edges = spark.createDataFrame([("act", f"n{i}") if i < 300 else (f"n{i}", f"n{i + 1}") for i in range(600)], "src string, dst string")
    nodes = edges.selectExpr("dst as uid")
    name = f"h{uuid.uuid4().hex}"
    kept = stored.store(Graph(nodes, edges), name, str(tmp_path), 8)
    found = {side: "Bucket" in "".join(r["col_name"] for r in spark.sql(f"describe formatted {name}_{side}").collect()) for side, _ in stored.SIDES}
    assert found == {"nodes": True, "edges_by_src": False, "edges_by_dst": True} and kept.edges.count() == 600
    for side, _ in stored.SIDES:
        spark.sql(f"drop table {name}_{side}")


def test_moved_edges_would_be_seen(spark, graphs, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "even", lambda *_: False)
    name = f"p{uuid.uuid4().hex}"
    kept = stored.store(graphs[0], name, str(tmp_path), 8)
    assert moved(plan_of(spark, TEMPLATES["amended_sections"](kept, limit=None)))
    for side, _ in stored.SIDES:
        spark.sql(f"drop table {name}_{side}")


def test_of_lines_of_one_number_the_last_in_its_file_wins(spark, tmp_path):
    duck = duckdb.connect()
    duck.sql("set threads = 1")
    made = {"customer": "select 0::bigint as c_custkey, 1.0::double as c_acctbal", "supplier": "select range as s_suppkey, 1.0::double as s_acctbal from range(50)", "orders": "select range as o_orderkey, 0::bigint as o_custkey from range(2000)"}
    for name, sql in made.items():
        duck.sql(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
        duck.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    (tmp_path / "lineitem.parquet").mkdir()
    for k, size in enumerate((1000, 200_000)):  # Spark reads the larger file first
        rows = f"select 1999 - range % 2 as l_orderkey, range % 50 as l_suppkey, 1::int as l_linenumber, 'A' as l_returnflag, {k * 1000} + range // 50 % 100 + 0.0::double as l_quantity from range({size})"
        duck.sql(f"copy ({rows}) to '{tmp_path}/lineitem.parquet/part-{k}.parquet' (format parquet)")
    duck.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    found = catalogue.queries()["upserted_edges"](spark, str(tmp_path)).select("src", "dst", "rel_type", "quantity")
    assert sorted(map(tuple, found.collect())) == sorted(duck.sql(catalogue.oracle_sql()["upserted_edges"]).fetchall()) == [(0, i, "A", 1099.0) for i in range(50)]


def test_linking_some_types_gives_their_edges_and_looks_up_one_end(spark):
    nodes = provisions.nodes_of(spark, SF)
    rows = lambda df: sorted(map(tuple, df.select("src", "dst", "rel_type").collect()))
    every = rows(link.link(nodes))
    for kinds in (("HAS_SUBSECTION",), ("REFERS_TO", "DERIVED_RULE"), ("SUBJECT_TO", "HAS_CLAUSE"), ("OMITS",)):
        assert rows(link.link(nodes, kinds)) == [r for r in every if r[2] in kinds]
    plan = link.link(nodes, ("HAS_SECTION",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 1 and "regexp" not in plan.lower()


def test_templates_without_hops_write_nothing_and_hops_link_their_types_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(provisions, "materialize", lambda df, name: written.append(name) or df)
    TEMPLATES["all_definitions"](provisions.graph_of(spark, SF))
    assert written == []
    TEMPLATES["penalty_bundle"](provisions.graph_of(spark, SF), n="7")
    assert sorted(written) == ["provision-edges"] * 4 + ["provisions"]  # subsections, clauses, subclauses, rules
