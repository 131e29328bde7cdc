import datetime

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators.index import Index
from lexloom.operators import graph, report, resolve, search
from lexloom.plans.engine import Engine, NOT_FOUND, Plan, citations_of, numbered, path_of, sources_of
from lexloom.plans.questions import prepared


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("a\0b   c\n\n\n\nd", "ab c\n\nd"), ("“x” — y–z", '"x" -- y-z'.replace('" --', '"  --').replace("  ", " ")), ("", "")])
def test_normalize(spark, text, want):
    assert one(spark, text, T.normalize) == want


def test_form_strip_and_slug(spark):
    assert one(spark, "Name......... ( ) ( ) ( ) ____________ x -------- y * * * * z", T.strip_form_templates) == "Name x - y z"
    assert one(spark, " The Companies (Act)! ", T.slugify) == "the-companies-act"


def test_language_and_garble(spark):
    assert one(spark, "धारा", T.script_language) == "hi"
    assert one(spark, "क " + "abcd", T.script_language) == "mixed"
    assert one(spark, "", T.script_language) == "en"
    assert one(spark, "()() ---- 123 ()() ---- 123 (((())))", T.is_garbled) is True
    assert one(spark, "plain words of a text", T.is_garbled) is False


def test_quality(spark):
    q = one(spark, "The company shall file with the registrar under this section of the act, and the board may appoint a director.", T.quality)
    assert q["is_usable"] and q["score"] > 60 and q["issues"] == []
    e = one(spark, "   ", T.quality)
    assert (e["score"], e["is_usable"], e["issues"]) == (0.0, False, ["EMPTY_TEXT"])
    n = one(spark, "x\0" * 30, T.quality)
    assert "NULL_BYTES" in n["issues"] and not n["is_usable"]


@pytest.mark.parametrize(("question", "want"), [("What amendments were made to section 135?", "structured_lookup"), ("How was section 135 amended?", "amendment_query"), ("What is the penalty under section 447?", "penalty_query"), ("What is the penalty?", "structured_lookup"), ("Which sections refer to section 135?", "cross_reference"), ("How many sections are there?", "general_info"), ("What is section 2?", "structured_lookup")])
def test_intent(spark, question, want):
    assert one(spark, question, T.intent) == want


def test_guard_terms_citations(spark):
    assert one(spark, "match (n) detach delete n", T.is_write) and not one(spark, "select 'drop it' as created", T.is_write)
    assert one(spark, "What does section 135 say about directors", T.search_terms) == "section 135 section~ say directors~"
    assert one(spark, "see [sec-1] and [def-x] and [sec-1] [Nope]", T.citations) == ["sec-1", "def-x"]
    assert [one(spark, u, T.label_of_uid) for u in ("sec-1-ss-2-cl-a", "sec-1-proviso-1", "rule-3", "schedule-i")] == ["Clause", "Proviso", "Rule", "Schedule"]
    assert [one(spark, u, T.target_uid) for u in ("section 135", "section 149A", "rule 3", "section 135(1)")] == ["sec-135", None, None, None]


D = datetime.date


@pytest.mark.parametrize(("chain", "text", "status", "links"), [
    ([], "old words", "original", 0),
    ([("SUBSTITUTES", "old", "new", 2019)], "new words", "amended", 1),
    ([("INSERTS", "", " more", 2019)], "old words more", "amended", 1),
    ([("OMITS", "old ", "", 2019)], "words", "omitted", 1),
    ([("DECRIMINALIZES", "", "", 2019)], "old words", "amended", 1),
    ([("SUBSTITUTES", "old", "new", 2019), ("OMITS", "words", "", 2020), ("SUBSTITUTES", "absent", "x", 2021)], "new ", "omitted", 3),
])
def test_effective_state(spark, chain, text, status, links):
    nodes = spark.createDataFrame([("sec-1", "Section", "1", "old words")], "uid string, label string, number string, text string")
    edges = spark.createDataFrame([("amend", "sec-1", k, n, o, D(y, 1, 1), i) for i, (k, o, n, y) in enumerate(chain)], "src string, dst string, rel_type string, new_text string, old_text string, effective_date date, seq long")
    s = resolve.effective_states(nodes, edges).first()["state"]
    assert (s["current_text"], s["status"], len(s["amendment_chain"]), s["original_text"]) == (text, status, links, "old words")
    early = resolve.effective_states(nodes, edges, D(2000, 1, 1)).first()["state"]
    assert early["current_text"] == "old words" and early["status"] == "original"


def test_upserts(spark):
    old = spark.createDataFrame([("L", "a", "x", None)], "label string, uid string, p string, q string")
    new = spark.createDataFrame([("L", "a", None, "1", 1), ("L", "a", "y", None, 2), ("L", "b", "z", None, 3)], "label string, uid string, p string, q string, ord int")
    got = {r["uid"]: (r["p"], r["q"]) for r in graph.upsert_nodes(old, new).collect()}
    assert got == {"a": ("y", "1"), "b": ("z", None)}
    with pytest.raises(ValueError, match="not unique"):
        graph.assert_unique(new)
    nodes = spark.createDataFrame([("a",), ("b",)], "uid string")
    edges = spark.createDataFrame([("a", "T", "b", "old", 1), ("a", "T", "b", "new", 2), ("a", "T", "gone", "x", 3), ("a", "BAD", "b", "x", 4)], "src string, rel_type string, dst string, new_text string, seq int")
    kept, rejected = graph.upsert_edges(nodes, edges, ["T"])
    assert [(r["dst"], r["new_text"]) for r in kept.collect()] == [("b", "new")] and rejected.count() == 1


def test_bm25_and_spelling(spark):
    docs = spark.createDataFrame([("a", "company law company"), ("b", "company"), ("c", "nothing here"), ("d", None)], "uid string, text string")
    assert [r["uid"] for r in search.bm25(docs, "uid", "text", ["company", "law"]).collect()] == ["a", "b"]
    words = spark.createDataFrame([("directer",), ("penelty",), ("zzzzzz",)], "word string")
    assert {r["word"]: r["correct"] for r in search.corrections(words).collect()} == {"directer": "director", "penelty": "penalty"}
    text = search.correct_text(spark.createDataFrame([(1, "Directer of a compeny!")], "k int, t string"), "k", "t").first()["t"]
    assert text == "Director of a company!"


NODES = "uid string, label string, parent string, number string, title string, term string, text string, ord long"


@pytest.fixture(scope="module")
def engine(spark):
    nodes = spark.createDataFrame([
        ("act-x", "Act", None, None, "Act", None, "", 0), ("ch-I", "Chapter", "act-x", "I", "PRELIMINARY", None, "", 1),
        ("sec-135", "Section", "ch-I", "135", "Social responsibility", None, "Every company shall spend two per cent", 2), ("sec-135-ss-1", "SubSection", "sec-135", "1", None, None, "(1) liable to a penalty", 3),
        ("def-company", "Definition", "sec-135", None, None, "company", "company means a thing", 4), ("amend-1", "AmendmentAct", None, None, "Amendment", None, "", 5),
    ], NODES)
    edges = spark.createDataFrame([("act-x", "ch-I", "HAS_CHAPTER", None, None, None, 0), ("ch-I", "sec-135", "HAS_SECTION", None, None, None, 0), ("sec-135", "sec-135-ss-1", "HAS_SUBSECTION", None, None, None, 0), ("amend-1", "sec-135", "SUBSTITUTES", "three", "two", D(2020, 1, 1), 0)], "src string, dst string, rel_type string, new_text string, old_text string, effective_date date, seq long")
    return Engine(spark, nodes, edges)


def test_engine_answers(engine):
    a = engine.ask("What is section 135?")
    assert a["sources"][0]["uid"] == "sec-135" and "[sec-135]" in a["answer"] and not a["metadata"]["fallback_used"]
    b = engine.ask("How was section 135 amended?")
    assert b["metadata"]["intent"] == "amendment_query" and "three per cent" in b["effective_state"]["current_text"]
    assert engine.ask("What is the penalty under section 135?")["query_text"].startswith("penalty_bundle")
    c = engine.ask("thing responsibility")
    assert c["metadata"]["fallback_used"] and c["sources"]
    assert engine.ask("qqqq")["answer"] == NOT_FOUND
    assert engine.ask(" WHAT IS SECTION 135? ") is a
    assert [e["event"] for e in engine.stream("How many sections are there?")][0] == "status"
    assert engine.sql("select count(*) as n from nodes")["results"] == [{"n": 6}]
    assert engine.sql("drop table nodes")["error"] and engine.sql("select nope from nodes")["error"]
    assert engine.schema()["labels"][0]["count"] == 1 and all(c["unique_uid"] for c in engine.schema()["constraints"])


def test_engine_with_a_stored_index(spark, engine, tmp_path):
    stored = Engine(spark, engine.graph.nodes, engine.graph.edges, f"{tmp_path}/index")
    assert stored.fallback("thing responsibility") == []  # no index there yet
    Index(spark, f"{tmp_path}/index").upsert(engine.graph.nodes)
    exact = stored.fallback("thing responsibility")
    assert exact == engine.fallback("thing responsibility") != []
    assert [r["uid"] for r in stored.fallback("thng responsibilty")] == [r["uid"] for r in exact] and engine.fallback("thng responsibilty") == []


def test_engine_sql_marks_what_it_leaves_out(spark, engine):
    query = "select w, uid from nodes lateral view explode(split('%s', ' ')) t as w order by cast(w as int) desc" % " ".join(map(str, range(400)))
    whole = engine.sql(query)
    assert len(whole["results"]) == 2400 and whole["results"][0]["w"] == "399" and not whole["truncated"]
    some = engine.sql(query, most=1000)
    assert [r["w"] for r in some["results"]] == [r["w"] for r in whole["results"]][:1000] and some["truncated"]
    assert not engine.sql(query, most=2400)["truncated"] and engine.read(query).count() == 2400
    slow = engine.sql("select count(*) from nodes a, nodes b, nodes c, nodes d, nodes e, nodes f, nodes g, nodes h, nodes i, nodes j, nodes k where a.text || b.text || c.text || k.text like '%q%'", seconds=1)
    assert "within 1 seconds" in slow["error"]


def test_engine_guard_and_limits(spark, engine, tmp_path):
    for query in (f"insert overwrite directory '{tmp_path}/x' using parquet select uid from nodes", "alter view nodes rename to other", "cache table nodes", "truncate table nodes", "update nodes set uid = ''", "add jar '/tmp/x.jar'", "call x()", f"select * from parquet.`{tmp_path}`", "select * from other", "select reflect('java.lang.System', 'getenv', 'HOME')", "select 1; select 2", "with n as (select * from other) select * from n", "select (select max(x) from other) as y from nodes"):
        got = engine.sql(query)
        assert got["error"] and not got["results"], query
    assert not list(tmp_path.iterdir())
    assert engine.sql("with n as (select uid from nodes) select count(*) as c from n join edges on uid = dst where uid <> 'call me'")["results"] == [{"c": 4}]
    many = [("act-x", "Act", None, None, "Act", None, "", 0)] + [(f"ch-{i}", "Chapter", "act-x", f"{i:03d}", f"C{i}", None, "", i) for i in range(60)]
    big = Engine(spark, spark.createDataFrame(many, NODES), engine.graph.edges)
    assert len(big.run(Plan("chapters_with_counts"))) == 50 and len(big.run(Plan("sections_mentioning", {"words": "x"}))) == 0
    Engine(spark, engine.graph.nodes, engine.graph.edges)


def test_engine_time_limit_and_errors(engine, monkeypatch):
    import time

    monkeypatch.setattr(engine, "run", lambda plan: time.sleep(3) or engine.spark.range(10**12).selectExpr("sum(id * id % 7)").collect())
    assert engine.ask("What is section 77?", seconds=2)["error"]["status"] == 504
    monkeypatch.setattr(engine, "run", lambda plan: 1 / 0)
    assert engine.ask("What is section 78?")["error"] == {"status": 500, "message": "division by zero"}


def test_question_preparation(spark):
    asked = ["What is CSR?", "penelty for direktor", "धारा 135 क्या है", "", "Sec. 5 of the Compny"]
    got = {r["key"]: r["prepared"] for r in prepared(spark.createDataFrame(list(enumerate(asked)), "key int, text string")).collect()}
    assert got == {0: "What is Corporate Social Responsibility (Section 135)?", 1: "penalty for director", 2: "धारा 135 क्या है [English: section 135 what is]", 3: "", 4: "section 5 of the Company"}
    s = sources_of([{"s_uid": "sec-1", "text": "a"}, {"number": "7"}, {"term": "Big Word"}], {"sec-1": "Section"})
    assert [(x["uid"], x["type"]) for x in s] == [("sec-1", "Section"), ("sec-7", "Node"), ("def-big-word", "Node")] and citations_of("see [sec-7] [sec-9]", s)[0]["uid"] == "sec-7"
    rows = [{"uid": "sec-1", "number": "1", "label": "Section"}, {"title": "T"}, {"uid": "sec-1", "number": "1", "label": "Section"}]
    assert path_of(rows) == "(Section:1) -> (Node:T)" and numbered([{"a": 1, "b": None}, {"c": "x"}]) == "[1] a: 1\n[2] c: x"


def test_devanagari_repairs_and_footnotes(spark):
    assert one(spark, "कख कख और ((( यह )))", T.clean_devanagari) == "कख और (यह )" and one(spark, "(((", T.clean_devanagari) == "((("
    assert one(spark, "Law text. Since then, see Gazette of India part II. More.", T.footnotes) == ["Since then, see Gazette of India part II."]


def test_reports(spark, engine):
    nodes, edges = engine.graph.nodes, engine.graph.edges
    r = report.parse_report(nodes).first()
    assert r["Section"] == 1 and "no provisos" in r["warnings"]
    checks = {x["check"]: x["n"] for x in report.integrity(nodes, edges).collect()}
    assert checks == {"orphans": 1, "broken_edges": 0, "repeated_uids": 0}
    assert report.missing_sections(nodes, 3).count() == 3 and report.audit(nodes).first()["nodes"] == 6


def test_audit_reports(spark, tmp_path):
    rows = [("act-x", "Act", None, None, "A", None, "", 0), ("ch-I", "Chapter", "act-x", "I", "P", None, "", 1), ("sec-1", "Section", "ch-I", "1", "T", None, "The company shall " * 40, 2), ("sec-2", "Section", "ch-I", "2", "U", None, "short", 3), ("lost", "Clause", "nowhere", None, None, None, "x", 4), ("rule-1", "Rule", None, "1", "Titled", None, "The company shall file it " * 9, 5), ("rule-2", "Rule", None, "2", "", None, "", 6)]
    nodes = spark.createDataFrame(rows, NODES)
    amendments = spark.createDataFrame([("SUBSTITUTES", "section 1", "", "raw a"), ("OTHER", "section 2", "new", "raw b"), ("OMITS", "somewhere", "", "raw c")], "amendment_type string, target_section string, new_text string, raw_text string")
    r = report.amendment_report(amendments).first()
    assert (r["amendments"], r["valid_type_pct"], r["with_text"], r["warnings"]) == (3, 66.7, 1, ["no known type: raw b", "no target: raw c"])
    assert tuple(report.rules_report(nodes).first()) == (2, 0, 50.0)
    assert {x["uid"]: x["depth"] for x in report.depths(nodes).collect()} == {"act-x": 0, "ch-I": 1, "sec-1": 2, "sec-2": 2, "lost": None, "rule-1": 0, "rule-2": 0}
    found = report.gaps(nodes, amendments, expected=3)
    assert [tuple(x) for x in found.collect()] == [("CRITICAL", "sections are missing", 1), ("CRITICAL", "texts are garbled", 1), ("HIGH", "amendments have no new text", 2), ("HIGH", "rules are empty", 1), ("MEDIUM", "sections are short", 1)]
    assert tuple(report.severity_counts(found).first()) == (2, 2, 1, 0)
    assert [x["uid"] for x in report.worst(nodes, 3).collect()] == ["act-x", "ch-I", "rule-2"]
    made = report.preprocess(nodes)
    assert {x["label"]: x["nodes"] for x in report.preprocess_report(made).collect()} == {"Act": 1, "Chapter": 1, "Section": 2, "Clause": 1, "Rule": 2}
    both = {x["label"]: x for x in report.compare_preprocess(nodes, made).collect()}
    assert both["Section"]["characters_before"] > both["Section"]["characters_after"] and both["Rule"]["empty_before"] == 1
    assert tuple(report.load_summary(nodes, spark.range(5), spark.range(3)).first()) == (7, 5, 3)
    report.write_audit(report.audit_report(nodes, amendments, 3), str(tmp_path / "audit"))
    assert spark.read.json(f"{tmp_path}/audit/gaps").count() == 5


def test_evaluation_percentiles(spark):
    runs = spark.createDataFrame([("a" if i % 2 else "b", "ok" if i != 3 else "late", i % 5 > 0, float(i)) for i in range(20)], "category string, status string, answer_ok boolean, latency_ms double")
    got = {r["category"]: r for r in report.evaluation(runs).collect()}
    want = sorted(float(i) for i in range(20) if i != 3)
    assert got[None]["n"] == 20 and [got[None][f"p{q}_ms"] for q in (50, 90, 99)] == [want[int(19 * q / 100)] for q in (50, 90, 99)] and got["a"]["ok_rate"] == 0.9


def test_edge_stream_and_untouched_buckets(spark, tmp_path):
    import json

    from lexloom.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    edge = lambda k, text, o: json.dumps({"src": f"a{k}", "dst": "s", "rel_type": "INSERTS", "new_text": text, "ord": o})
    run = lambda: ingest.upsert_into(ingest.edge_stream(spark, str(src)), str(tmp_path / "t"), str(tmp_path / "c"), ingest.EDGE_KEYS).awaitTermination(120)
    (src / "1.json").write_text("\n".join(edge(k, "one", 1) for k in range(30)))
    run()
    before = {p.name for p in (tmp_path / "t" / "v=0").glob("bucket=*")}
    for k in (2, 3, 4):
        (src / f"{k}.json").write_text(edge(7, f"v{k}", k))
        run()
    got = {r["src"]: r["new_text"] for r in ingest.current(spark, str(tmp_path / "t")).collect()}
    assert got == {f"a{k}": "v4" if k == 7 else "one" for k in range(30)}
    assert len(list((tmp_path / "t" / "v=3").glob("bucket=*"))) == 1 and {p.name for p in (tmp_path / "t" / "v=0").glob("bucket=*")} < before  # old versions of the hot bucket went


def test_stream_upserts_are_idempotent(spark, tmp_path):
    import json

    from lexloom.streaming import ingest

    src, schema = tmp_path / "in", "label string, uid string, text string, ord long"
    src.mkdir()
    (src / "1.json").write_text(json.dumps({"label": "Section", "uid": "sec-1", "text": "a", "ord": 1}))
    ingest.upsert_into(ingest.node_stream(spark, str(src), schema), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    (src / "2.json").write_text(json.dumps({"label": "Section", "uid": "sec-1", "text": "b", "ord": 2}))
    ingest.upsert_into(ingest.node_stream(spark, str(src), schema), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert [r["text"] for r in ingest.current(spark, str(tmp_path / "t")).collect()] == ["b"]


def test_scores_read_a_text_once_for_each_count(spark):
    """Each pattern stands once in the plan of a score: bound counts aren't taken anew where they are used."""
    from lexloom.functions import text as T

    df = spark.createDataFrame([("a",)], "text string")
    for made in (T.audit_score(F.col("text")), T.is_garbled(F.col("text"))):
        plan = df.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("(?U)[\\s&&[^ ]]") == 1


def test_counts_of_odd_texts(spark):
    from lexloom.functions import text as T

    texts = ["", " ", "　  ", "a", " a b c \n", "○●□ ··¶ a†", "Section section, act-act Act1 _act act", "x\u0085y z", "\t\x00\x01\x02 ○○ . . . . . . ", None]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(T.stripped_length(F.col("text")), T.glyph_count(F.col("text"), T.NOISE_GLYPHS), T.legal_count(F.col("text")), T.nonspace(F.col("text")), T._dense(T._spaced(F.col("text")))).collect()
    for t, (n, glyphs, legal, dense, same) in zip(texts, got):
        if t is None:
            assert n is None and glyphs is None
            continue
        bare = t.strip("\t\n\x0b\x0c\r \u0085   　")
        assert n == len(bare) and glyphs == sum(c in T.NOISE_GLYPHS for c in t) and dense == same
        assert legal == (4 + 1 if t.startswith("Section") else 0)


def test_a_walk_doubles_only_parents(spark, monkeypatch):
    """Leaves take no part in the rounds, and get what their parent has."""
    from lexloom.operators import graph

    written = []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append((name, out := keep(df, name), out.count())) or out)
    rows = [("r", None), ("a", "r"), ("b", "a"), ("lone", None), ("x", "y"), ("y", "x"), ("onx", "x"), ("l", "gone"), ("m", "l")] + [(f"leaf{i}", "b") for i in range(50)]
    got = {r["uid"]: tuple(r)[1:] for r in graph.walk(spark.createDataFrame(rows, "uid string, parent string")).collect()}
    reached = lambda root, depth: (root, depth, "reached")
    assert got == {"r": reached("r", 0), "a": reached("r", 1), "b": reached("r", 2), "lone": reached("lone", 0), "l": (None, None, "lost"), "m": (None, None, "lost")} | {u: (None, None, "cycle") for u in ("x", "y", "onx")} | {f"leaf{i}": reached("r", 3) for i in range(50)}
    assert max(n for name, _, n in written if name == "walk") == 6
