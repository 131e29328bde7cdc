"""Walks, validity and streamed links over the given tables, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators import graph, resolve
from lexloom.plans.provision_queries import amendments_of, nodes_of, twin
from lexloom.plans.registry import Registry, table
from lexloom.streaming.links import LinkedGraph
from lexloom.tables import materialize, shared_dir

reg = Registry()

@reg.query("""select uid, case when kind = 'reached' then root end as root, case when kind = 'reached' then depth end as depth, kind as state from (
  select cast(event_id as varchar) as uid, cast(first_value(event_id) over (partition by user_id order by ts, event_id) as varchar) as root, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as depth, case when user_id % 10 = 3 then 'lost' when user_id % 10 = 7 then 'cycle' else 'reached' end as kind from events)""")
def chain_walk(spark: SparkSession, d: str) -> DataFrame:
    """Root, depth and state of events whose parent is the user's event before; some chains begin nowhere, some are closed to a ring."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    placed = table(spark, d, "events").select("event_id", "user_id", F.lag("event_id").over(w).alias("before"), F.last("event_id").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("latest"))
    first = F.when(F.col("user_id") % 10 == 3, F.lit(-1)).when(F.col("user_id") % 10 == 7, F.col("latest"))
    return graph.walk(placed.select(F.col("event_id").cast("string").alias("uid"), F.coalesce("before", first).cast("string").alias("parent")))


_STATES = """ordered as (select dst, rel_type, new_text, old_text, effective_date, row_number() over (partition by dst order by effective_date, seq) as k from amendments),
state as (select uid, text as txt, case when exists (select 1 from ordered where dst = uid) then 'amended' else 'original' end as status, cast(0 as bigint) as k, cast(null as date) as day from nodes where label = 'Section'
  union all select s.uid, case when o.rel_type in ('SUBSTITUTES', 'DECRIMINALIZES') and o.old_text <> '' then replace(s.txt, o.old_text, o.new_text) when o.rel_type = 'INSERTS' then s.txt || o.new_text when o.rel_type = 'OMITS' and o.old_text <> '' then replace(s.txt, o.old_text, '') else s.txt end,
    case when o.rel_type = 'OMITS' then 'omitted' else s.status end, o.k, o.effective_date from state s join ordered o on o.dst = s.uid and o.k = s.k + 1)"""


@reg.query(twin(f", {_STATES} select * from (select uid, k as version, day as valid_from, lead(day) over (partition by uid order by k) as valid_to, txt as current_text, case when k = 0 then 'original' else status end as status from state) where valid_to is null or valid_from is null or valid_to > valid_from"))
def section_validity(spark: SparkSession, d: str) -> DataFrame:
    """Every state of every section and the days between which it holds."""
    return resolve.validity(nodes_of(spark, d), amendments_of(spark, d)).select("uid", F.col("version").cast("long").alias("version"), "valid_from", "valid_to", "current_text", "status")


@reg.query(twin(f""", {_STATES} select o_orderkey, p.uid, p.day, k as version, txt as current_text, case when k = 0 then 'original' else status end as status from (select o_orderkey, 'sec-' || o_custkey as uid, cast(o_orderdate as date) + 200 as day from orders) p left join state s on s.uid = p.uid and (s.day is null or s.day <= p.day)
qualify row_number() over (partition by o_orderkey order by k desc) = 1"""))
def sections_as_of_days(spark: SparkSession, d: str) -> DataFrame:
    """The text that each order's section had 200 days after the order."""
    pairs = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("sec-"), F.col("o_custkey").cast("string")).alias("uid"), F.date_add(F.col("o_orderdate").cast("date"), 200).alias("day"))
    states = materialize(resolve.validity(nodes_of(spark, d), amendments_of(spark, d)), "validity")
    return resolve.as_of(pairs, states).select("o_orderkey", "uid", "day", F.col("version").cast("long").alias("version"), "current_text", "status")


@reg.query("select 'order-' || o_orderkey as src, 'customer-' || o_custkey as dst, 'OF' as rel_type, cast(o_orderdate as date) as effective_date from orders where o_orderkey % 7 <> 3 and o_custkey in (select c_custkey from customer where c_custkey % 5 <> 2)")
def streamed_links(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a stream whose edges come before their nodes: those whose two ends have come, too."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    root = f"{shared_dir(spark)}/lexloom/streamed-{uuid.uuid4().hex}"
    none = F.lit(None).cast("string")
    edge = orders.select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("dst"), F.lit("OF").alias("rel_type"), none.alias("new_text"), none.alias("old_text"), F.col("o_orderdate").cast("date").alias("effective_date"), F.col("o_orderkey").alias("ord"))
    of = lambda df, label, key: df.select(F.lit(label).alias("label"), F.concat(F.lit(f"{label}-"), F.col(key).cast("string")).alias("uid"), F.col(key).alias("ord"))
    waves = [(None, edge), (of(customer.where("c_custkey % 5 <> 2"), "customer", "c_custkey"), None), (of(orders.where("o_orderkey % 7 <> 3"), "order", "o_orderkey"), edge.where("ord % 50 = 0"))]
    kinds = {"nodes": of(customer, "customer", "c_custkey"), "edges": edge}
    made = LinkedGraph(spark, f"{root}/graph")
    for k, wave in enumerate(waves):
        for kind, rows in zip(kinds, wave, strict=True):
            (kinds[kind].limit(0) if rows is None else rows).write.parquet(f"{root}/{kind}/{k}")
        made.follow(*[spark.readStream.schema(df.schema).parquet(f"{root}/{kind}/*") for kind, df in kinds.items()], f"{root}/checkpoint").awaitTermination()
    return made.table("edges").select("src", "dst", "rel_type", "effective_date")
