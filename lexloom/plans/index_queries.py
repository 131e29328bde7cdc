"""The stored index and guarded reads over the given tables, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.index import Index
from lexloom.plans.guard import Guard
from lexloom.plans.registry import Registry, table
from lexloom.plans.text_queries import QUERY
from lexloom.tables import shared_dir

reg = Registry()
MISSPELT = ("nichtt", "tionmd", "verwaltunk")


def _twin(docs: str, weights: str, limit: str = "order by score desc, doc_id limit 15") -> str:
    """BM25 over ``docs`` (doc_id, text) of the terms and weights that ``weights`` gives."""
    return f"""with docs as ({docs}), t as materialized (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as t from docs),
s as (select count(*) as n, avg(len(t)) as avgdl from t), each as (select doc_id, len(t) as dl, unnest(t) as term from t),
w as materialized ({weights}), tf as (select doc_id, dl, term, count(*) as tf from each where term in (select term from w) group by all),
df as (select term, count(*) as df from tf group by term)
select doc_id, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
from tf join df using (term) join w using (term), s group by doc_id {limit}"""


_EXACT = f"select unnest({list(QUERY)!r}) as term, 1.0 as weight"
#: DuckDB measures distance in bytes, so letters beyond ASCII, which the misspelt words lack, become one other sign.
_NEAR = f"""select term, sum(1 - levenshtein(q, a)::double / least(length(q), length(a))) as weight from (select distinct term, regexp_replace(term, '[^\\x00-\\x7F]', '?', 'g') as a from each), (select unnest({list(MISSPELT)!r}) as q)
  where levenshtein(q, a) <= 2 and levenshtein(q, a) < least(length(q), length(a)) group by term"""
#: Documents after a second batch has replaced some texts and a third has taken some out.
_LATER = "select doc_id, case when doc_id % 5 = 1 then upper(text) || ' nicht the' else text end as text from documents where doc_id % 11 <> 3"


def _rows(spark: SparkSession, found) -> DataFrame:
    """As many as were asked for, at most."""
    return spark.createDataFrame([(int(uid), score) for uid, score in found.rows], "doc_id long, score double")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("uid"), "text")


def _new_index(spark: SparkSession) -> Index:
    return Index(spark, f"{shared_dir(spark)}/lexloom/index-{uuid.uuid4().hex}", ("text",))


@reg.query(_twin("select doc_id, text from documents", _EXACT))
def indexed_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best documents from a stored index, by its blocks."""
    index = _new_index(spark)
    index.upsert(_documents(spark, d))
    found = index.search(QUERY)
    index.drop()
    return _rows(spark, found)


@reg.query(_twin("select doc_id, text from documents", _NEAR))
def indexed_fuzzy_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best documents for misspelt words: all near terms of the index, weighted by nearness."""
    index = _new_index(spark)
    index.upsert(_documents(spark, d))
    found = index.search(index.near(MISSPELT))
    index.drop()
    return _rows(spark, found)


@reg.query(_twin(_LATER, _EXACT))
def indexed_upserts_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best documents after batches that replace and remove some, and a merge of their segments."""
    docs, index = table(spark, d, "documents"), _new_index(spark)
    index.upsert(_documents(spark, d))
    index.upsert(docs.where("doc_id % 5 = 1").select(F.col("doc_id").cast("string").alias("uid"), F.concat(F.upper("text"), F.lit(" nicht the")).alias("text")))
    index.upsert(_documents(spark, d).limit(0), docs.where("doc_id % 11 = 3").select(F.col("doc_id").cast("string").alias("uid")))
    index.merge(1)
    found = index.search(QUERY)
    index.drop()
    return _rows(spark, found)


_ASKED = "with recent as (select o_custkey, count(*) as n, max(o_orderdate) as last from orders where o_orderdate >= date '1995-01-01' group by o_custkey) select c_mktsegment as segment, count(*) as customers, sum(n) as orders, max(last) as last from customer join recent on c_custkey = o_custkey where c_nationkey in (select n_nationkey from nation where n_name <> 'NATION_3') group by c_mktsegment"


@reg.query(_ASKED)
def guarded_read(spark: SparkSession, d: str) -> DataFrame:
    """A user's read query over named views, judged by its analyzed plan."""
    return Guard(spark, {t: table(spark, d, t) for t in ("customer", "orders", "nation")}).read(_ASKED)
