"""Full-text search and spelling: postings, BM25 by a scan, fuzzy joins by deletion variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.vocabulary import LEAST_LENGTH, LEGAL_VOCABULARY, MOST_EDITS
from lexloom.tables import materialize, release

K1, B, LEAST_SCORE, TOP = 1.2, 0.75, 0.3, 15


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def postings(nodes: DataFrame, fields: Sequence[str] = ("text", "title", "term")) -> DataFrame:
    """term, uid, field, tf, dl of all given fields; one explode, combined before its shuffle."""
    parts = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(f), F.lit(""))).alias("t")) for f in fields])
    per = nodes.select("uid", F.explode(parts).alias("p")).select("uid", "p.field", F.size("p.t").alias("dl"), F.explode("p.t").alias("term"))
    return per.groupBy("term", "uid", "field").agg(F.count("*").cast("int").alias("tf"), F.max("dl").alias("dl"))


def _equals(word: str):
    return lambda x: x == word


def bm25(docs: DataFrame, key: str, text: str, terms: Sequence[str], least: float | None = None, top: int = TOP, digits: int = 6) -> DataFrame:
    """key, score of the best documents for a query.

    Only the query's terms leave the scan: term counts are taken inside each
    row's token array, so no token is exploded or shuffled. The counts are written
    once, so texts are split once; ``index.Index`` stores postings for many queries.
    """
    wanted = sorted(set(terms))
    split = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    counted = split.select(key, F.size("t").alias("dl"), *[F.size(F.filter("t", _equals(w))).alias(f"tf{k}") for k, w in enumerate(wanted)])
    counted = materialize(counted, "search-counts")
    totals = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(wanted))])
    found = counted.where(" or ".join(f"tf{k} > 0" for k in range(len(wanted))) or "false").crossJoin(F.broadcast(totals))  # one row
    score = F.lit(0.0)
    for k in range(len(wanted)):
        idf = F.ln(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        tf = F.col(f"tf{k}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    ranked = found.select(key, F.round(score, digits).alias("score"))
    if least is not None:
        ranked = ranked.where(F.col("score") > least)
    best = docs.sparkSession.createDataFrame(ranked.orderBy(F.desc("score"), key).limit(top).collect(), ranked.schema)
    release(counted)
    return best


def _without_one(words: Column) -> Column:
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))))


def deletion_variants(word: Column, edits: int = MOST_EDITS) -> Column:
    """All words left after taking out up to ``edits`` characters."""
    level = out = F.array(word)
    for _ in range(edits):
        level = F.array_distinct(_without_one(level))
        out = F.concat(out, level)
    return F.array_distinct(out)


def fuzzy_pairs(left: DataFrame, right: DataFrame, a: str, b: str, edits: int = MOST_EDITS) -> DataFrame:
    """(a, b, dist) of words within ``edits``.

    Words within k edits share a variant with at most k characters deleted, so
    the theta join is an equality join on variants, verified by the distance.
    """
    x = left.select(a).distinct().select(a, F.explode(deletion_variants(F.col(a), edits)).alias("_v"))
    y = right.select(b).distinct().select(b, F.explode(deletion_variants(F.col(b), edits)).alias("_v"))
    dist = F.levenshtein(F.col(a), F.col(b))
    return x.join(y, "_v").select(a, b).distinct().withColumn("dist", dist).where(F.col("dist") <= edits)


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in LEGAL_VOCABULARY], "correct string")


def corrections(words: DataFrame, column: str = "word") -> DataFrame:
    """word, correct, dist: the nearest dictionary term, least in order among the nearest."""
    some = words.where(F.length(column) >= LEAST_LENGTH).where(~F.col(column).isin(LEGAL_VOCABULARY))
    near = fuzzy_pairs(some, dictionary(words.sparkSession), column, "correct")
    return near.groupBy(column).agg(F.min(F.struct("dist", "correct")).alias("m")).select(column, "m.correct", "m.dist")


def correct_text(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key and its text with misspelt words replaced; leading capitals stay."""
    split = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))).alias("pos", "piece"))
    fixed = corrections(split.select(F.lower("piece").alias("word")).where("word rlike '^[a-z]+$'"))
    joined = split.join(fixed, F.lower("piece") == F.col("word"), "left")
    piece = F.when(F.col("correct").isNull(), F.col("piece")).when(F.col("piece").rlike("^[A-Z]"), F.initcap("correct")).otherwise(F.col("correct"))
    return joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("p")))), lambda x: x["p"]), "").alias(text))
