import datetime
import random

import pytest

from lexloom.operators import graph, report, resolve
from lexloom.streaming.ingest import EDGES
from lexloom.streaming.links import LinkedGraph, both

D = datetime.date
NODES = "label string, uid string, text string, ord long"


def edge(src, dst, text=None, order=0):
    return (src, dst, "T", text, None, None, order)


def rows(df):
    return set() if df is None else {(r["src"], r["dst"], r["new_text"]) for r in df.collect()}


@pytest.mark.parametrize("order", ["edges first", "nodes first", "mixed"])
def test_edges_wait_for_both_ends(spark, tmp_path, order):
    made = LinkedGraph(spark, f"{tmp_path}/graph")
    nodes = [("L", u, u, k) for k, u in enumerate("abcde")]
    edges = [edge("a", "b", "old", 1), edge("c", "a"), edge("d", "e"), edge("a", "gone"), edge("gone", "gone2"), edge("e", "d")]
    batches = {"edges first": [([], edges), (nodes, [])], "nodes first": [(nodes, []), ([], edges)], "mixed": [(nodes[:1], edges[:3]), (nodes[1:3], edges[3:]), (nodes[3:4], []), (nodes[4:], [edge("a", "b", "new", 2)])]}[order]
    for epoch, (n, e) in enumerate(batches):
        batch = both(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES))
        for _ in range(2):  # a replay writes the same rows
            made.apply(batch, epoch)
    sent = [x for _, e in batches for x in e]
    kept, _ = graph.upsert_edges(spark.createDataFrame(nodes, NODES), spark.createDataFrame(sent, EDGES).withColumnRenamed("ord", "seq"))
    assert rows(made.table("edges")) == rows(kept) and len(rows(kept)) == 4
    assert {(r["src"], r["dst"], r["waits_for"]) for r in made.table("waiting").collect()} == {("a", "gone", "gone"), ("gone", "gone2", "gone")}
    made.apply(both(spark.createDataFrame([("L", "gone", "", 9)], NODES), spark.createDataFrame([], EDGES)), 9)
    assert rows(made.table("edges")) == rows(kept) | {("a", "gone", None)}
    assert {(r["src"], r["waits_for"]) for r in made.table("waiting").collect()} == {("gone", "gone2")}


def test_a_stream_of_files(spark, tmp_path):
    made = LinkedGraph(spark, f"{tmp_path}/graph")
    for k, (n, e) in enumerate([([], [edge("a", "b")]), ([("L", "a", "", 0)], []), ([("L", "b", "", 1)], [edge("b", "a")])]):
        spark.createDataFrame(n, NODES).coalesce(1).write.json(f"{tmp_path}/n/{k}")
        spark.createDataFrame(e, EDGES).coalesce(1).write.json(f"{tmp_path}/e/{k}")
        read = lambda kind, schema: spark.readStream.schema(schema).json(f"{tmp_path}/{kind}/*")
        made.follow(read("n", NODES), read("e", EDGES), f"{tmp_path}/checkpoint").awaitTermination()
    assert rows(made.table("edges")) == {("a", "b", None), ("b", "a", None)} and not made.table("waiting").count()


def test_walk_doubles_its_pointers(spark, monkeypatch):
    chain = [("n0", None)] + [(f"n{i}", f"n{i - 1}") for i in range(1, 1000)]
    odd = [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("below", "c1"), ("self", "self"), ("lost", "nowhere"), ("loster", "lost"), ("root", None)]
    rounds, written = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: rounds.append(name) or written(df, name))
    got = {r["uid"]: (r["root"], r["depth"], r["state"]) for r in graph.walk(spark.createDataFrame(chain + odd, "uid string, parent string")).collect()}
    assert all(got[f"n{i}"] == ("n0", i, "reached") for i in range(1000)) and got["root"] == ("root", 0, "reached")
    assert {k: got[k][2] for k, _ in odd[:-1]} == {"c1": "cycle", "c2": "cycle", "c3": "cycle", "below": "cycle", "self": "cycle", "lost": "lost", "loster": "lost"} and got["lost"][:2] == (None, None)
    assert len(rounds) <= 12  # the start, ten rounds, and one that finds no more
    labelled = spark.createDataFrame([(u, "L", p) for u, p in odd], "uid string, label string, parent string")
    assert {(r["uid"], r["state"]) for r in report.unrooted(labelled).collect()} == {(u, got[u][2]) for u, _ in odd[:-1]}
    assert {r["uid"]: r["depth"] for r in report.depths(labelled).collect()} == {u: got[u][1] for u, _ in odd}


def test_walk_of_random_trees(spark):
    random.seed(5)
    parent = {i: random.choice([None, random.randrange(200), random.randrange(260)]) for i in range(200)}
    def by_hand(i):
        seen, k = {i}, 0
        while parent[i] is not None:
            if parent[i] not in parent:
                return None, None, "lost"
            i, k = parent[i], k + 1
            if i in seen:
                return None, None, "cycle"
            seen.add(i)
        return str(i), k, "reached"
    df = spark.createDataFrame([(str(i), None if p is None else str(p)) for i, p in parent.items()], "uid string, parent string")
    assert {r["uid"]: (r["root"], r["depth"], r["state"]) for r in graph.walk(df).collect()} == {str(i): by_hand(i) for i in parent}
    assert graph.walk(df.limit(0)).collect() == []


def test_states_and_days_agree_with_a_fold_for_each_day(spark):
    random.seed(7)
    sections = spark.createDataFrame([(f"s{i}", str(i), "Section", "one two three") for i in range(6)], "uid string, number string, label string, text string")
    day = lambda: D(2000, 1, 1) + datetime.timedelta(random.choice([0, 1, 40, 400, 800, 2000]))
    kinds = ("SUBSTITUTES", "INSERTS", "OMITS", "DECRIMINALIZES", "OTHER")
    edges = spark.createDataFrame([(f"a{k}", f"s{random.randrange(5)}", random.choice(kinds), random.choice(["two", "nine", ""]), random.choice(["one", "two", "nine", "", None]), day(), k) for k in range(40)] + [("x", "s1", "INSERTS", "never", None, None, 99)], "src string, dst string, rel_type string, new_text string, old_text string, effective_date date, seq long")
    states = resolve.validity(sections, edges)
    days = [D(1990, 1, 1), D(2000, 1, 1), D(2000, 1, 2), D(2000, 1, 3), D(2001, 6, 1), D(2002, 5, 5), D(2030, 1, 1)]
    pairs = spark.createDataFrame([(f"s{i}", d, k) for k in range(2) for i in range(7) for d in days], "uid string, day date, k int")
    for width in (10, 366, 100_000):
        got = {(r["uid"], r["day"]): (r["current_text"], r["status"], r["version"]) for r in resolve.as_of(pairs, states, width).collect()}
        assert resolve.as_of(pairs, states, width).count() == pairs.count()
        for d in days:
            want = {r["uid"]: (r["state"]["current_text"], r["state"]["status"], len(r["state"]["amendment_chain"])) for r in resolve.effective_states(sections, edges, d).collect()}
            assert {u: got[u, d] for u in want} == want and got["s6", d] == (None, None, None)
    assert resolve.as_of(pairs.limit(0), states).collect() == []


def test_texts_say_where_they_stand(spark):
    nodes = spark.createDataFrame([
        ("act", "Act", None, None, "Act", None, ""), ("ch", "Chapter", "act", "IV", "BOARDS", None, ""), ("s", "Section", "ch", "7", "Keeping", None, "All is kept"), ("ss", "SubSection", "s", "2", None, None, "(2) and more"), ("rs", "RuleSet", None, None, "Filing Rules", None, ""), ("r", "Rule", "rs", "3", "Forms", None, "File the form of the company"),
        ("lost", "Clause", "nowhere", "a", None, None, "(a) x"), ("c1", "Clause", "c2", "a", None, None, "x"), ("c2", "Clause", "c1", "b", None, None, "y"),
    ], "uid string, label string, parent string, number string, title string, term string, text string")
    got = {r["uid"]: r["llm_text"] for r in report.in_context(report.preprocess(nodes)).collect()}
    assert got["s"] == "Chapter IV - BOARDS > Section 7 (Keeping)\n\nAll is kept" and got["r"] == "Filing Rules > Rule 3 (Forms)\n\nFile the form of the company"
    assert got["ss"] == "Act > Chapter IV > Section 7\n\n(2) and more" and got["lost"] is None and got["c1"] is None and len(got) == 9
