"""Quality rules: base statistics and a learned decision list, all native.

Every statistic is a column expression over the whole text. The decision list
is learned from a bounded sample of labelled documents (SAMPLE rows at most, by
hash) by sequential covering: a conjunction of thresholds is grown by FOIL gain
on two thirds of the sample and pruned on the last third, rows that it covers
are set aside, and the next one is grown, until a rule is not precise enough.
Each step's counts are one aggregation over (feature, bin); the list becomes an
ordered conditional expression that Spark evaluates with the statistics.

Defined cases: null and empty texts have no words, so base_failed is true;
labels without a document or with nulls are ignored; without labels of both
kinds the list is empty and only the base rules decide; repeated rows stay; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import SPACE, let, materialize, reading, release, words_of

#: Bound on the labelled rows that rules are learned from.
SAMPLE = 20_000
BINS, MOST_RULES, MOST_CONDITIONS = 24, 8, 3
#: Least precision and coverage of a rule on the pruning part.
PRECISION, COVERED = 0.9, 5


class Condition(NamedTuple):
    feature: str
    sign: str  # ">=" or "<"
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.sign == ">=" else value < self.threshold


Rule = list[Condition]


def _covered(places: Column) -> Column:
    """Words in three-word windows that start at the given rising places."""
    return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more, first ones included.

    Windows are sorted by their hash, then place, so equal ones are neighbours.
    """
    windows = let(words, lambda w: F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.cast("long").alias("i")))).otherwise(F.array().cast("array<struct<h:bigint,i:bigint>>")))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    found = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1))))
    return _covered(F.sort_array(F.transform(found, lambda x: x["i"])))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def _left(text: Column, pattern: str) -> Column:
    """Code points that are left when the pattern's matches are taken out."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("words", "word_length", "symbols", "bars", "dup_lines", "repeats", "upper", "shouts", "distinct")


def statistics(docs: DataFrame, *carried: str) -> DataFrame:
    """doc, a struct of the carried columns, and s, a struct of the base statistics and the learned ones' ratios.

    The input's columns stay inside ``doc``, so their names can't clash with those made here.
    """
    rows = docs.select(F.struct(*carried).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    counted = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct")))
    raw = rows.select("doc", counted.alias("w"), F.struct(_left(text, SPACE).alias("word_chars"), _left(text, "[^#*$%&|<>]+").alias("n_symbols"), _left(text, "[^|]+").alias("n_bars"), duplicate_lines(text).alias("n_dup_lines"), _left(text, "[^A-Z]+").alias("n_upper"), _left(text, "[^!]+").alias("n_shouts"), (_left(text, "[^\\n]+") + 1).alias("n_lines")).alias("c"))
    n = F.greatest(F.col("w.n_words"), F.lit(1)).cast("double")
    per = lambda x, y=n: (F.col(x) / y)
    made = {"words": F.col("w.n_words").cast("double"), "word_length": per("c.word_chars"), "symbols": per("c.n_symbols"), "bars": per("c.n_bars"), "dup_lines": per("c.n_dup_lines", F.col("c.n_lines").cast("double")), "repeats": per("w.n_repeat_words"), "upper": per("c.n_upper", F.greatest(F.col("c.word_chars"), F.lit(1)).cast("double")), "shouts": per("c.n_shouts"), "distinct": per("w.n_distinct")}
    base = {"n_words": "w.n_words", "word_chars": "c.word_chars", "n_symbols": "c.n_symbols", "n_dup_lines": "c.n_dup_lines", "n_repeat_words": "w.n_repeat_words"}
    return raw.select("doc", F.struct(*[F.col(v).alias(k) for k, v in base.items()], *[v.alias(k) for k, v in made.items()]).alias("s"))


def base_failed(s: str = "") -> Column:
    return F.expr(f"{s}n_words < 50 or 100 * {s}n_repeat_words > 50 * {s}n_words")


def labelled_sample(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, bad (quality 0) and prune (a third) of at most about SAMPLE labelled documents."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = known.count()
    share = min(1.0, SAMPLE / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = measured.select("doc.doc_id", "s").join(F.broadcast(chosen), "doc_id")  # bounded by SAMPLE
    rows = some.select("quality", "s.*", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("prune"))
    return rows.where(~base_failed()).select((F.col("quality") == 0).alias("bad"), "prune", *RATIOS)


def _grid(rows: DataFrame) -> dict[str, list[float]]:
    cuts = rows.agg(*[F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 2000).alias(f) for f in RATIOS]).first()
    tops = rows.where("bad").agg(*[F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 2000).alias(f) for f in RATIOS]).first()
    return {f: sorted({x for found in (cuts, tops) if found[f] for x in found[f]}) for f in RATIOS}


def _tally(rows: DataFrame, rule: Rule, grid: dict[str, list[float]]) -> list:
    """Counts of bad and good rows that the rule covers, for each feature and bin."""
    for c in rule:
        rows = rows.where(c.column())
    bins = F.array(*[F.struct(F.lit(f).alias("f"), sum(((F.col(f) >= x).cast("int") for x in cuts), F.lit(0)).alias("bin")) for f, cuts in grid.items()])
    return rows.select("bad", F.explode(bins).alias("b")).groupBy("b.f", "b.bin").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()


def _grow(rows: DataFrame, grid: dict[str, list[float]]) -> Rule:
    rule: Rule = []
    while len(rule) < MOST_CONDITIONS:
        best, tally = (0.0, None), _tally(rows, rule, grid)
        for f, cuts in grid.items():
            p, n = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1)
            for r in tally:
                if r["f"] == f:
                    p[r["bin"]], n[r["bin"]] = r["p"], r["n"]
            all_p, all_n = sum(p), sum(n)
            if not all_p or not all_n:
                continue
            now = math.log2(all_p / (all_p + all_n))
            for k, x in enumerate(cuts):
                low_p, low_n = sum(p[: k + 1]), sum(n[: k + 1])
                for sign, a, b in ((">=", all_p - low_p, all_n - low_n), ("<", low_p, low_n)):
                    if a and (gain := a * (math.log2(a / (a + b)) - now)) > best[0] + 1e-9:
                        best = gain, Condition(f, sign, float(x))
        if best[1] is None:
            break
        rule.append(best[1])
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of the rule with the best worth on the pruning rows, and its counts there."""
    held, counts = F.lit(True), []
    for k, c in enumerate(rule):
        held = held & c.column()
        counts += [F.count_if(held & F.col("bad")).alias(f"p{k}"), F.count_if(held & ~F.col("bad")).alias(f"n{k}")]
    found = rows.agg(*counts).first()
    worth = [((found[f"p{k}"] - found[f"n{k}"]) / max(found[f"p{k}"] + found[f"n{k}"], 1), -k) for k in range(len(rule))]
    best = max(range(len(rule)), key=lambda k: worth[k])
    return rule[: best + 1], found[f"p{best}"], found[f"n{best}"]


def learn(rows: DataFrame) -> list[Rule]:
    """Decision list: the rules that reject, in order."""
    rows = materialize(rows, "rules-sample")
    rules = _list(rows) if rows.select("bad").distinct().count() > 1 else []
    release(rows)
    return rules


def _list(rows: DataFrame) -> list[Rule]:
    rules: list[Rule] = []
    grid = _grid(rows)
    rest = rows
    while len(rules) < MOST_RULES:
        rule = _grow(rest.where(~F.col("prune")), grid)
        if not rule:
            break
        rule, p, n = _prune(rest.where("prune"), rule)
        if p < COVERED or p < PRECISION * (p + n):
            break
        rules.append(rule)
        rest = rest.where(~_all(rule))
    return rules


def _all(rule: Rule) -> Column:
    held = F.lit(True)
    for c in rule:
        held = held & c.column()
    return held


def decision(rules: list[Rule], at: str = "") -> Column:
    """Ordered conditional expression: number of the first rule that rejects, else null."""
    out = None
    for k, rule in enumerate(rules, 1):
        held = _all([c._replace(feature=f"{at}{c.feature}") for c in rule])
        out = F.when(held, k) if out is None else out.when(held, k)
    return out if out is not None else F.lit(None).cast("int")


def judged(docs: DataFrame, labels: DataFrame, *carried: str) -> DataFrame:
    """doc (struct of the carried columns, doc_id among them), s (statistics), rule (of the list, or null) and kept.

    The statistics are computed once, in a table of their own; rules are learned from it and judge it.
    """
    measured = materialize(statistics(docs, *carried), "rules-measured")
    rules = learn(labelled_sample(measured, labels))
    found = measured.withColumn("rule", decision(rules, "s."))
    return reading(found.withColumn("kept", ~base_failed("s.") & F.col("rule").isNull()), measured)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) without those that the base rules or the list reject."""
    found = judged(docs, labels, *docs.columns)
    return reading(found.where("kept").select("doc.*"), *found._lexloom_reads)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality) -> the base statistics, base_failed, kept, rule."""
    return judged(docs, labels, "doc_id").select("doc.doc_id", *[f"s.{c}" for c in BASE], base_failed("s.").alias("base_failed"), "kept", "rule")
