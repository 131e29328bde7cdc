import json

from lexloom.operators import report, resolve
from lexloom.plans.engine import Engine
from lexloom.plans.ingest import ingest


def p(text, kind="paragraph"):
    return {"type": kind, "content": text, "page number": 1}


def test_three_files_to_answers(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    act = [p("CHAPTER I", "heading"), p("PRELIMINARY", "heading"), p("2. Definitions.— In this Act"), p("(20) “company” means a company incorporated under this Act"), p("Audit", "heading"), p("135. Social responsibility.— Every company shall spend two per cent subject to section 2, and the board shall report to the registrar"), p("(1) the company is liable to a penalty under section 2"), p("Provided that the board may decide")]
    amendment = [p("In the Companies Act, 2013, in section 135, for the words two, the words three shall be substituted"), p("In the said Act, in section 999, x shall be omitted")]
    rules = [p("3. Reporting of the board", "heading"), p("The board of the company shall report under section 135 to the registrar as prescribed, and the company shall file it"), p("Form No. MGT-7", "heading"), p("Name of the company")]
    for name, kids in (("companies_act_2013", act), ("amendment_2026", amendment), ("companies_rules", rules)):
        (raw / f"{name}.json").write_text(json.dumps({"kids": kids}))
    got = ingest(spark, str(raw), str(tmp_path / "out"))
    again = ingest(spark, str(raw), str(tmp_path / "out"))  # idempotent
    uids = {r["uid"] for r in again.nodes.collect()}
    assert {"act-companies-2013", "ch-I", "sec-2", "sec-2-ss-20", "def-company", "sec-135", "sec-135-ss-1", "sec-135-ss-1-proviso-1", "rule-3", "form-mgt-7", "amend-corporate-laws-2026"} <= uids
    edges = {(r["src"], r["rel_type"], r["dst"]) for r in again.edges.collect()}
    assert {("sec-135", "SUBJECT_TO", "sec-2"), ("sec-135-ss-1", "IMPOSES_PENALTY", "sec-2"), ("rule-3", "DERIVED_RULE", "sec-135"), ("amend-corporate-laws-2026", "SUBSTITUTES", "sec-135"), ("amend-corporate-laws-2026", "AMENDED_BY", "act-companies-2013"), ("sec-2-ss-20", "DEFINES", "def-company")} <= edges
    assert not [e for e in edges if e[2] == "sec-999"] and got.amendments.count() == 2
    checks = {r["check"]: r["n"] for r in report.integrity(again.nodes, again.edges).collect()}
    assert checks == {"orphans": 0, "broken_edges": 0, "repeated_uids": 0}
    counted = spark.read.json(f"{tmp_path}/out/report").first()  # observed by the jobs that wrote
    assert (counted["Section"], counted["Rule"], counted["nodes"], counted["edges"]) == (2, 1, again.nodes.count(), again.edges.count())
    state = {r["uid"]: r["state"]["status"] for r in resolve.effective_states(again.nodes, again.edges).collect()}
    assert state == {"sec-2": "original", "sec-135": "amended"}
    engine = Engine(spark, again.nodes, again.edges)
    assert engine.ask("What is section 135?")["sources"][0]["uid"] == "sec-135"
    assert "rule-3" in [s["uid"] for s in engine.ask("Which rules refer to section 135?")["sources"]]
