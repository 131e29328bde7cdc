"""Questions to answers: spelling and abbreviations, intent, template and slots,
run, full-text fallback, effective text, extractive answer with sources."""

from __future__ import annotations

import inspect
import re
import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import resolve, search
from lexloom.operators.index import Index
from lexloom.plans import questions, templates
from lexloom.plans.guard import Guard, Refused
from lexloom.plans.templates import TEMPLATES, Graph

NOT_FOUND = "I could not find relevant information in the indexed documents for this question."
CACHED, MOST_ROWS, FETCHED, EXCERPT, TIMEOUT = 128, 25, 10_000, 200, 90.0

@dataclass(frozen=True)
class Plan:
    """A template and its slots: what is run for a question."""

    template: str
    slots: dict[str, str] = field(default_factory=dict)

    def __str__(self) -> str:
        return f"{self.template}({', '.join(f'{k}={v!r}' for k, v in self.slots.items())})"


def candidates(question: str, intent: str) -> list[Plan]:
    """Templates to try in order: the exact one first, broader ones after it."""
    low = question.lower()
    section = re.search(r"section\s+(\d+)", low)
    rule = re.search(r"rule\s+(\d+[a-z]?)", low)
    chapter = re.search(r"chapter\s+([ivxlc]+)\b", low)
    term = re.search(r"(?:definition|meaning) of \W*([a-z][a-z -]*)|(?:what is|define) (?:an? |the )?\W*([a-z][a-z -]*?)\W*$", low)
    words = next((g.strip() for g in term.groups() if g), "") if term else ""
    out: list[Plan] = []
    n = {"n": section.group(1)} if section else {}
    if intent == "amendment_query":
        kind = next((k for k, p in (("OMITS", "omit"), ("DECRIMINALIZES", "decriminal"), ("SUBSTITUTES", "substitut"), ("INSERTS", "insert")) if p in low), None)
        out += [Plan("amendments_of", n)] if n else [Plan("amendments_in_chapter", {"chapter": chapter.group(1).upper()})] if chapter else []
        out += [Plan("sections_changed", {"rel": kind})] if kind and not n else []
        out += [Plan("section_with_amendments", n)] if n else [Plan("amended_sections")]
    elif intent == "penalty_query":
        out += [Plan("penalty_bundle", n), Plan("penal_subsections", n)] if n else [Plan("liabilities")]
    elif intent == "cross_reference":
        if "notwithstanding" in low:
            out.append(Plan("notwithstanding_pairs"))
        if "no corresponding" in low or "no related" in low or "no matching" in low:
            out.append(Plan("chapters_without_rules"))
        if n:
            out += [Plan("rules_for", n)] if "rule" in low else [Plan("subject_to_of", n)] if "subject to" in low else [Plan("references_to", n)]
    elif intent == "general_info":
        out += [Plan("count_chapters")] if "how many chapter" in low else [Plan("count_sections")] if "how many section" in low else []
        out += [Plan("sections_of_chapter", {"chapter": chapter.group(1).upper()})] if chapter else []
        out.append(Plan("chapters_with_counts"))
    if intent in ("structured_lookup", "general_info", "cross_reference"):
        out += [Plan("section_with_subsections", n)] if n else [Plan("rule_by_number", {"n": rule.group(1).upper()})] if rule else [Plan("sections_of_chapter", {"chapter": chapter.group(1).upper()})] if chapter else []
        out += [Plan("meaning_of", {"term": words}), Plan("sections_mentioning", {"words": words})] if words else []
    unique = dict.fromkeys((p.template, tuple(p.slots.items())) for p in out)
    return [Plan(name, dict(slots)) for name, slots in unique]


def _uids(row: dict) -> list[str]:
    uids = [v for k, v in row.items() if v and (k == "uid" or k.endswith(("_uid", ".uid")))]
    if not uids and row.get("number"):
        uids = [f"sec-{row['number']}" if str(row["number"]).isdigit() else f"rule-{row['number']}"]
    elif not uids and row.get("term"):
        uids = ["def-" + re.sub(r"[^a-z0-9]+", "-", row["term"].lower()).strip("-")]
    return uids


def sources_of(rows: list[dict], labels: dict[str, str] | None = None) -> list[dict]:
    """uid, type and excerpt of each uid that the rows name, once, in order; ``labels`` gives types that rows lack."""
    found: dict[str, dict] = {}
    for row in rows:
        for uid in _uids(row):
            text = row.get("text") or row.get("title") or row.get("term") or row.get("new_text") or ""
            found.setdefault(uid, {"uid": uid, "type": row.get("type") or (labels or {}).get(uid, "Node"), "excerpt": str(text)[:EXCERPT]})
    return list(found.values())


def path_of(rows: list[dict], labels: dict[str, str] | None = None) -> str:
    """``(Label:id)`` of each row, once, in order, joined by arrows."""
    steps = []
    for row in rows:
        label = row.get("type") or row.get("label") or next(((labels or {}).get(u, "Node") for u in _uids(row)), "Node")
        name = next((str(row[k]) for k in ("number", "uid", "title") if row.get(k)), "?")
        steps.append(f"({label}:{name})")
    return " -> ".join(dict.fromkeys(steps))


def numbered(rows: list[dict]) -> str:
    """Rows as numbered records of their non-empty fields."""
    return "\n".join(f"[{k}] " + "; ".join(f"{name}: {value}" for name, value in row.items() if value not in (None, "", [])) for k, row in enumerate(rows, 1))


def citations_of(answer: str, sources: list[dict]) -> list[dict]:
    known = {s["uid"]: s for s in sources}
    return [known[u] for u in dict.fromkeys(re.findall(r"\[([a-z][\w-]*)\]", answer)) if u in known]


@contextmanager
def limited(spark: SparkSession, seconds: float | None) -> Iterator[threading.Event]:
    """Cancels the jobs started inside after so many seconds; the event tells whether that happened."""
    tag, late = f"question-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop) if seconds is not None else None
    spark.sparkContext.addJobTag(tag)
    if timer:
        timer.start()
    try:
        yield late
    finally:
        if timer:
            timer.cancel()
        spark.sparkContext.removeJobTag(tag)


class Engine:
    """Answers over one graph; nodes and edges are read many times and may be cached by the caller.

    ``index`` is a folder of ``index.Index`` over the nodes, which also finds misspelt
    words; without it the fallback reads all texts for each question.
    """

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, index: str | None = None, edges_by_dst: DataFrame | None = None):
        self.spark, self.graph, self.index = spark, Graph(nodes, edges, edges_by_dst), index
        self.answers: OrderedDict[str, dict] = OrderedDict()
        self.guard = Guard(spark, {"nodes": nodes, "edges": edges})

    def intent(self, question: str) -> str:
        return self.spark.range(1).select(T.intent(F.lit(question))).first()[0]

    def prepare(self, question: str) -> str:
        return questions.prepared(self.spark.createDataFrame([(0, question)], "key int, text string")).first()["prepared"]

    def run(self, plan: Plan) -> list[dict]:
        """Rows of a template: as many as it declares, or at most MOST_ROWS if it declares no limit."""
        made = TEMPLATES[plan.template]
        found = made(self.graph, **plan.slots)
        if "limit" not in inspect.signature(made).parameters:
            found = found.limit(MOST_ROWS)
        return [r.asDict(recursive=True) for r in found.collect()]

    def labels(self, rows: list[dict]) -> dict[str, str]:
        """Labels by the form of the uids that the rows name without a type."""
        uids = sorted({u for row in rows if not row.get("type") for u in _uids(row)})
        if not uids:
            return {}
        return {r["uid"]: r["label"] for r in self.spark.createDataFrame([(u,) for u in uids], "uid string").select("uid", T.label_of_uid(F.col("uid")).alias("label")).collect()}

    def read(self, query: str) -> DataFrame:
        """The frame of a read query over the views nodes and edges, with nothing run yet; raises ``guard.Refused``."""
        return self.guard.read(query)

    def sql(self, query: str, most: int = FETCHED, seconds: float | None = TIMEOUT) -> dict:
        """Rows of a read query as data, in its own order; errors are data too.

        At most ``most`` rows come to the driver; ``truncated`` tells whether there
        are more, which ``read`` has all.
        """
        with limited(self.spark, seconds) as late:
            try:
                rows = self.read(query).limit(most + 1).collect()
                return {"results": [r.asDict(recursive=True) for r in rows[:most]], "truncated": len(rows) > most, "error": None}
            except (Refused, PySparkException, Py4JJavaError) as e:
                return {"results": [], "truncated": False, "error": f"no result within {seconds} seconds" if late.is_set() else str(e)}

    def fallback(self, question: str) -> list[dict]:
        """The best nodes by full text, none if nothing matches or the index is not there.

        With an index, words marked ``~`` stand for all terms near them, weighted by nearness.
        """
        terms = self.spark.range(1).select(T.search_terms(F.lit(question), fuzzy=self.index is not None)).first()[0].lower()
        fuzzy = re.findall(r"(\w+)~", terms)
        exact = re.findall(r"\w+", re.sub(r"\w+~", " ", terms))
        if self.index:
            found = Index(self.spark, self.index)
            weights = found.near(fuzzy)
            for word in exact:
                weights[word] = weights.get(word, 0.0) + 1.0
            best = found.search(weights, search.LEAST_SCORE).rows
        elif exact:
            text = F.concat_ws(" ", "text", "title", "term")
            best = [(r["uid"], r["score"]) for r in search.bm25(self.graph.nodes.select("uid", text.alias("body")), "uid", "body", exact, search.LEAST_SCORE).collect()]
        else:
            best = []
        if not best:
            return []
        scores = dict(best)
        rows = self.graph.nodes.where(F.col("uid").isin(list(scores))).select("uid", F.col("label").alias("type"), "title", "term", "text").collect()
        return sorted(({"uid": r["uid"], "score": scores[r["uid"]]} | {k: r[k] for k in ("type", "title", "term", "text")} for r in rows), key=lambda r: (-r["score"], r["uid"]))

    def effective(self, number: str, as_of=None) -> dict | None:
        section = self.graph.section(number)
        uids = [r["uid"] for r in section.select("uid").collect()]
        row = resolve.effective_states(section, self.graph.edges.where(F.col("dst").isin(uids)), as_of).first()
        return row["state"].asDict(recursive=True) if row else None

    def stream(self, question: str) -> Iterator[dict]:
        """Events of one answer in order: status, query, sources, token..., done."""
        began = time.monotonic()
        text = self.prepare(question)
        intent = self.intent(text)
        yield {"event": "status", "data": {"stage": "classified", "intent": intent}}
        rows, plan, tried, source = [], None, 0, "graph"
        for plan in candidates(text, intent)[:3]:
            tried += 1
            rows = self.run(plan)
            if rows:
                break
        yield {"event": "query", "data": {"query_text": str(plan) if plan else ""}}
        if not rows:
            rows, source = self.fallback(text), "fulltext"
        n = re.search(r"section\s+(\d+)", text.lower())
        state = self.effective(n.group(1)) if intent == "amendment_query" and n and rows else None
        labels = self.labels(rows)
        sources = sources_of(rows, labels)
        yield {"event": "sources", "data": sources}
        lines = [f"{(s['excerpt'] or s['type']).strip()} [{s['uid']}]" for s in sources[:5]]
        if state and state["status"] != "original":
            lines.insert(0, f"The text in force ({state['status']}): {state['current_text'][:800]}")
        answer = "\n".join(lines) if lines else str(rows[0]) if rows else NOT_FOUND
        for line in answer.split("\n"):
            yield {"event": "token", "data": line}
        yield {"event": "done", "data": {"answer": answer, "query_text": str(plan) if plan else "", "sources": sources, "citations": citations_of(answer, sources), "effective_state": state, "path": path_of(rows, labels), "records": numbered(rows), "metadata": {"intent": intent, "retry_count": tried, "source_type": source, "fallback_used": source == "fulltext", "latency_ms": (time.monotonic() - began) * 1000}}}

    def ask(self, question: str, seconds: float | None = TIMEOUT) -> dict:
        """The answer, or a body with ``error``: its status (504 if time ran out, else 500) and message."""
        key = question.strip().lower()
        if key not in self.answers:
            with limited(self.spark, seconds) as late:
                try:
                    self.answers[key] = next(e["data"] for e in self.stream(question) if e["event"] == "done")
                except Exception as e:
                    return {"error": {"status": 504 if late.is_set() else 500, "message": f"no answer within {seconds} seconds" if late.is_set() else str(e)}}
            while len(self.answers) > CACHED:
                self.answers.popitem(last=False)
        return self.answers[key]

    def clear(self) -> None:
        self.answers.clear()

    def schema(self) -> dict[str, list[dict]]:
        """Counts by label and by edge type, and whether uids are unique in each label."""
        unique = self.graph.nodes.groupBy("label").agg((F.count("*") == F.countDistinct("uid")).alias("unique_uid")).orderBy("label")
        return {"constraints": [r.asDict() for r in unique.collect()], "labels": [r.asDict() for r in templates.label_counts(self.graph).collect()], "relationships": [r.asDict() for r in templates.rel_counts(self.graph).collect()]}
