"""Aliases of operator 2: spellings, hostile urls, chains beyond any number of rounds."""

import time

import duckdb

from lexloom.llm import op2_urls
from lexloom.llm.common import connected_components

BAD = "http://y.org/es/3"
BLOCKED = [
    f'<link rel=canonical href="{BAD}">', f"<LINK HREF='{BAD}' REL='alternate canonical'>", f'<link title="a > b" rel="canonical" href={BAD}>', f"<meta content='0;url={BAD}' http-equiv='refresh'>",
    f"<meta http-equiv=refresh content=0;url={BAD}>", f"""<meta http-equiv="Refresh" content="5; URL='{BAD}'">""", f'<meta content="0, {BAD}" http-equiv="refresh">',
    f'<link rel="canonical" href="/nowhere"><p>x</p><link rel="canonical" href="{BAD}">', f'<meta http-equiv="refresh" content="1;url=/else"><meta http-equiv="refresh" content="1;url={BAD}">',
    '<link rel="canonical" href="//y.org/es/3#part">', f'<!-- c --><link rel="canonical" href="{BAD}"><!-- d -->',
]
ALLOWED = [
    f'<!-- <link rel="canonical" href="{BAD}"> -->', f'<script>var a = \'<link rel="canonical" href="{BAD}">\'</script>', f'<link data-rel="canonical" href="{BAD}">', f'<link rel="alternate" href="{BAD}">', f'<a rel="canonical" href="{BAD}">x</a>',
    f'<meta name="refresh" content="0;url={BAD}">', f'<link title=" rel=canonical " href="{BAD}">', '<link rel="canonical" href="#y">', '<link rel="canonical">', "<meta http-equiv=refresh content=5>", "canonical refresh <link", '<link rel="canonical',
]


def test_all_spellings_carry_and_sql_agrees(spark):
    rows = [(i, f"http://h{i}.io/a/b", h) for i, h in enumerate(BLOCKED + ALLOWED)] + [(90, "http://org/es/", ""), (91, None, BLOCKED[0]), (92, "no host", BLOCKED[0])]
    rows += [(93, "http://w.net/p/q/r?x=1#f", '<link rel=canonical href="s">'), (94, "http://w.net/p/q/s", f"<link rel=canonical href='{BAD}'>"), (95, "http://w.net", '<link rel=canonical href="?y=2">'), (96, "http://w.net/?y=2", f"<link rel=canonical href='{BAD}&amp;z'>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in op2_urls.judge(df).collect()}
    assert [got[i] for i in range(len(BLOCKED))] == ["block"] * len(BLOCKED)
    assert [got[len(BLOCKED) + i] for i in range(len(ALLOWED))] == ["allow"] * len(ALLOWED)
    assert got[91] == got[92] == "allow" and [got[i] for i in (90, 93, 94, 95, 96)] == ["block"] * 5
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", rows)
    assert {r[0]: r[1] for r in c.sql(op2_urls.oracle()).select("page_id", "verdict").fetchall()} == got


def test_dot_segments_and_references(spark):
    assert op2_urls.resolved("http://a.io/x/y/z", "../w") == "http://a.io/x/w" and op2_urls.resolved("http://a.io/x/y", "./w/.") == "http://a.io/x/w/"
    assert op2_urls.resolved("http://a.io", "../../w?u=/../v") == "http://a.io/w?u=/../v" and list(op2_urls.links_of('<link rel=canonical href="http:&#x2F;/a.io&#47;b">')) == ["http://a.io/b"]


def test_hostile_pages_take_no_long_time(spark):
    deep = "http://h.io" + "/a" * 100_000
    rows = [(1, deep, '<link rel="canonical" href="x">'), (2, "http://h.io/" + "b" * 300_000, '<link rel="canonical" href="x">'), (3, "http://h.io/c", "canonical" + '<link "' * 60_001 + "<meta '" * 60_001), (4, "http://h.io/d", "canonical" + "<!--<script" * 60_000), (5, "http://h.io/e", "<link " + "rel='canonical' " * 50_000 + ">"), (6, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    began = time.time()
    assert {r["page_id"]: len(r["path"]) for r in op2_urls.judge(df).collect()} == {1: 200_000, 2: 300_001, 3: 2, 4: 2, 5: 2, 6: 0}
    assert time.time() - began < 60


def test_components_of_a_long_chain(spark):
    edges = spark.range(1000).selectExpr("(id * 7919) % 1001 as a", "((id + 1) * 7919) % 1001 as b")
    assert [tuple(r) for r in connected_components(edges).groupBy("root").count().collect()] == [(0, 1001)]


def test_rules_say_what_the_contract_lists(spark):
    said = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    rows = [(i, f"http://{'' if r.startswith('example.') else 'w.'}{r}", "") for i, r in enumerate(said)]
    rows += [(10, "http://free.net/a", '<link rel="canonical" href="http://b.example.net/de/8">'), (11, "http://free.net/b", '<link rel="canonical" href="http://y.net/de/3">')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in op2_urls.judge(df).collect()}
    assert got == {**dict(enumerate(said.items())), 10: (None, "block"), 11: (None, "allow")}
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in c.sql(op2_urls.oracle()).select("page_id", "rule", "verdict").fetchall()} == got
