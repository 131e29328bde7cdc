"""Graph-shaped queries over the driver's tables.

Containment: region > nation > customer > orders > lineitem. Reference edges:
lineitem REFERS_TO part, lineitem PRESCRIBES_FOR supplier. Each query has the
shape of one of the question templates or loader steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.operators import graph
from lexloom.plans.registry import Registry, table

reg = Registry()


@reg.query("select n_nationkey, n_name, n_regionkey from nation where n_nationkey = 7")
def node_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").where("n_nationkey = 7").select("n_nationkey", "n_name", "n_regionkey")


@reg.query("select p_partkey, p_name from part where contains(p_name, 'ring')")
def term_contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.col("p_name").contains("ring")).select("p_partkey", "p_name")


@reg.query("select doc_id, lang from documents where contains(lower(text), 'the')")
def term_contains_ci(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.lower("text").contains("the")).select("doc_id", "lang")


@reg.query("select o_orderkey, o_orderstatus from orders where cast(o_orderkey as varchar) = '42'")
def string_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    # the key is compared as a number, so that the filter reaches the scan
    return table(spark, d, "orders").where(F.col("o_orderkey") == int("42")).select("o_orderkey", "o_orderstatus")


@reg.query("select n_name, c_custkey, c_name from nation join customer on n_nationkey = c_nationkey")
def children_ordered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "c_custkey", "c_name").orderBy("n_name", "c_custkey")


@reg.query("select c_nationkey as nationkey, 'party' as kind from customer where c_acctbal > 9000 union select s_nationkey, 'party' from supplier where s_acctbal > 9000")
def union_distinct_lookup(spark: SparkSession, d: str) -> DataFrame:
    kind = F.lit("party").alias("kind")
    a = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nationkey"), kind)
    return a.unionByName(table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("nationkey"), kind)).distinct()


@reg.query("select c_custkey, string_agg(cast(o_orderkey as varchar), '|' order by o_orderkey) as order_keys from customer left join orders on o_custkey = c_custkey group by c_custkey")
def optional_collect(spark: SparkSession, d: str) -> DataFrame:
    per = graph.collect_children(table(spark, d, "orders"), "o_custkey", "o_orderkey", "order_keys")
    return table(spark, d, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "order_keys")


@reg.query("select c_custkey, string_agg(cast(o_orderkey as varchar), '|' order by o_orderkey) as open_keys from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'O' group by c_custkey")
def optional_filtered_collect(spark: SparkSession, d: str) -> DataFrame:
    per = graph.collect_children(table(spark, d, "orders").where("o_orderstatus = 'O'"), "o_custkey", "o_orderkey", "open_keys")
    return table(spark, d, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "open_keys")


@reg.query("select o_orderkey, string_agg(distinct cast(l_returnflag as varchar), '|' order by cast(l_returnflag as varchar)) as flags from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def collect_distinct(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("flags"))
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "flags")


@reg.query("select o_orderkey, string_agg(l_linestatus || ':' || l_returnflag || ':' || cast(l_partkey as varchar), '|' order by l_partkey, l_linestatus, l_returnflag) as lines from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def collect_struct(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.col("l_partkey").alias("k"), F.col("l_linestatus").alias("s"), F.col("l_returnflag").alias("f"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat_ws(":", x["s"], x["f"], x["k"].cast("string"))), "|").alias("lines"))
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "lines")


@reg.query("""with c as (select c_nationkey k, count(*) n from customer group by 1), s as (select s_nationkey k, count(*) n from supplier group by 1)
select n_nationkey, coalesce(c.n, 0) as customers, coalesce(s.n, 0) as suppliers from nation left join c on c.k = n_nationkey left join s on s.k = n_nationkey""")
def branch_preagg(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    zero = F.lit(0).cast("long")
    return table(spark, d, "nation").select("n_nationkey").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_nationkey", F.coalesce("customers", zero).alias("customers"), F.coalesce("suppliers", zero).alias("suppliers"))


@reg.query("select event_id, user_id, event_type from events where event_type in ('purchase', 'signup')")
def type_in_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type").isin("purchase", "signup")).select("event_id", "user_id", "event_type")


EDGES = """edges as (
select 'HAS_NATION' as rel_type, n_regionkey as src, n_nationkey as dst from nation union all
select 'HAS_CUSTOMER', c_nationkey, c_custkey from customer union all
select 'HAS_ORDER', o_custkey, o_orderkey from orders union all
select 'REFERS_TO', l_orderkey, l_partkey from lineitem union all
select 'PRESCRIBES_FOR', l_orderkey, l_suppkey from lineitem)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    parts = [("HAS_NATION", table(spark, d, "nation"), "n_regionkey", "n_nationkey"), ("HAS_CUSTOMER", table(spark, d, "customer"), "c_nationkey", "c_custkey"), ("HAS_ORDER", table(spark, d, "orders"), "o_custkey", "o_orderkey"), ("REFERS_TO", line, "l_orderkey", "l_partkey"), ("PRESCRIBES_FOR", line, "l_orderkey", "l_suppkey")]
    return graph.union_all([df.select(F.lit(t).alias("rel_type"), F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")) for t, df, a, b in parts])


@reg.query(f"with {EDGES} select distinct rel_type, cast(src as bigint) as src, cast(dst as bigint) as dst from edges where rel_type in ('REFERS_TO', 'PRESCRIBES_FOR')")
def type_alternation(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).where(F.col("rel_type").isin("REFERS_TO", "PRESCRIBES_FOR")).distinct()


@reg.query("select r_name, count(o_orderkey) as orders from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by r_name")
def three_hop_chain(spark: SparkSession, d: str) -> DataFrame:
    hop = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return hop.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(F.count("o_orderkey").alias("orders"))


@reg.query("select n_name, o_orderkey from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey where o_orderstatus = 'P'")
def anonymous_hop(spark: SparkSession, d: str) -> DataFrame:
    middle = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return table(spark, d, "orders").where("o_orderstatus = 'P'").join(middle, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "o_orderkey")


@reg.query("select 'Part' as label, p_name as name, count(*) as refs from lineitem join part on p_partkey = l_partkey group by p_name union all select 'Supplier', s_name, count(*) from lineitem join supplier on s_suppkey = l_suppkey group by s_name")
def inbound_refs_with_label(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")

    def inbound(label: str, node: str, key: str, fk: str, name: str) -> DataFrame:
        counts = line.groupBy(fk).agg(F.count("*").alias("n"))  # small before the join
        return table(spark, d, node).join(counts, F.col(key) == F.col(fk)).groupBy(F.col(name).alias("name")).agg(F.sum("n").alias("refs")).select(F.lit(label).alias("label"), "name", "refs")

    return inbound("Part", "part", "p_partkey", "l_partkey", "p_name").unionByName(inbound("Supplier", "supplier", "s_suppkey", "l_suppkey", "s_name"))


@reg.query("select n_nationkey, count(distinct c_custkey) as customers, count(o_orderkey) as orders from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by n_nationkey")
def two_level_optional(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    each = table(spark, d, "customer").join(per, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))
    zero = F.lit(0).cast("long")
    return table(spark, d, "nation").select("n_nationkey").join(each, "n_nationkey", "left").select("n_nationkey", F.coalesce("customers", zero).alias("customers"), F.coalesce("orders", zero).alias("orders"))


@reg.query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def anti_join_not_exists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@reg.query("select p_partkey as uid from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 48 and l_partkey is not null)")
def orphan_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no large line leads to."""
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("uid"))
    return graph.orphans(nodes, table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("dst")))


@reg.query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_join_endpoints(spark: SparkSession, d: str) -> DataFrame:
    some = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(some, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@reg.query("select n_name, count(c_custkey) as members from nation left join customer on c_nationkey = n_nationkey group by n_name")
def two_phase_size(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("n"))
    return table(spark, d, "nation").join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0).cast("long")).alias("members"))


@reg.query("select count(o_orderkey) as total from orders")
def count_all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count("o_orderkey").alias("total"))


@reg.query("select c_custkey, count(o_orderkey) as orders from customer left join orders on o_custkey = c_custkey group by c_custkey")
def optional_count(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("orders"))


LABELS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@reg.query(" union all ".join(f"select '{t}' as label, count(*) as n from {t}" for t in LABELS))
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.union_all([table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("label"), "n") for t in LABELS])


@reg.query(f"with {EDGES} select rel_type, count(*) as n from edges group by rel_type")
def rel_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("rel_type").agg(F.count("*").alias("n"))


@reg.query("select distinct o_orderstatus, o_orderpriority from orders")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@reg.query("select doc_id, substr(text, 1, 150) as preview from documents order by doc_id limit 25")
def order_limit_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").orderBy("doc_id").limit(25).select("doc_id", F.substring("text", 1, 150).alias("preview"))


@reg.query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 15")
def top_k_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15).select("o_orderkey", "o_totalprice")


@reg.query("select p_partkey, p_name from part order by p_partkey limit 25")
def auto_limit_guard(spark: SparkSession, d: str) -> DataFrame:
    return graph.limited(table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey"))


TIES = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax"


@reg.query(f"select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by {TIES}) as rn from lineitem) where rn = 1")
def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return graph.first_of(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], TIES.split(", ")).select("l_orderkey", "l_linenumber", "l_partkey")


@reg.query("select l_orderkey, l_linenumber, l_partkey, l_suppkey from (select *, row_number() over (partition by l_orderkey, l_linenumber order by " + ", ".join(f"{c} desc" for c in TIES.split(", ")) + ") as rn from lineitem) where rn = 1")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("seq", F.struct(*TIES.split(", ")))
    return graph.last_wins(rows, ["l_orderkey", "l_linenumber"], "seq", ["l_partkey", "l_suppkey"])


@reg.query("select l_orderkey, l_partkey, l_suppkey, l_shipdate, cast(row_number() over (partition by l_orderkey order by l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice) as bigint) as ordinal from lineitem")
def running_ordinal(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", F.row_number().over(w).cast("long").alias("ordinal"))


@reg.query("select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as context from events")
def carry_forward_context(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("context"))


@reg.query("select p_partkey, case when row_number() over (partition by p_name order by p_partkey) > 1 then p_name || '-dup-' || cast(row_number() over (order by p_partkey) - 1 as varchar) else p_name end as uid from part")
def dup_suffix(spark: SparkSession, d: str) -> DataFrame:
    return graph.with_duplicate_suffix(table(spark, d, "part"), "p_name", "p_partkey").select("p_partkey", "uid")


@reg.query("select k as missing from (select unnest(range(1, (select max(o_orderkey) + 1 from orders))) as k) where k not in (select l_orderkey from lineitem)")
def missing_numbers(spark: SparkSession, d: str) -> DataFrame:
    top = table(spark, d, "orders").agg(F.max("o_orderkey").alias("m")).first()["m"] or 0
    return spark.range(1, top + 1).withColumnRenamed("id", "missing").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("missing")), "missing", "left_anti")


@reg.query("select event_type, min(q50) as p50, min(q90) as p90, min(q99) as p99, cast(count(*) as bigint) as n from (select event_type, list_sort(list(value) over (partition by event_type))[cast(floor((count(*) over (partition by event_type)) * 0.5) as bigint) + 1] as q50, list_sort(list(value) over (partition by event_type))[cast(floor((count(*) over (partition by event_type)) * 0.9) as bigint) + 1] as q90, list_sort(list(value) over (partition by event_type))[cast(floor((count(*) over (partition by event_type)) * 0.99) as bigint) + 1] as q99 from events) group by event_type")
def nearest_rank_percentile(spark: SparkSession, d: str) -> DataFrame:
    return graph.nearest_rank(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@reg.query("select count(*) filter (where o_orderstatus = 'F') as finished, count(*) filter (where o_orderstatus = 'O') as opened, count(*) filter (where o_totalprice > 200000) as large, count(*) as total from orders")
def conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("opened"), F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.count("*").alias("total"))


@reg.query("select cast(least(round(100.0 * (select count(distinct doc_id) from labels) / (select count(*) from documents), 1), 100) as double) as coverage_pct")
def coverage_pct(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "labels").agg(F.countDistinct("doc_id").alias("a"))
    every = table(spark, d, "documents").agg(F.count("*").alias("b"))
    return found.crossJoin(every).select(F.least(F.round(F.lit(100.0) * F.col("a") / F.col("b"), 1), F.lit(100.0)).alias("coverage_pct"))  # one row each


@reg.query("""with l as (select user_id, ts, event_id, event_type, cast(round(value * 100) as bigint) as v from events where ts <= timestamp '2024-01-20 00:00:00')
select user_id, list_reduce(list_prepend(0, list(case event_type when 'purchase' then v when 'error' then -1 else null end order by ts, event_id)), lambda a, x: case when x is null then a when x = -1 then 0 else a + x end) as balance, count(*) as chain from l group by user_id""")
def effective_state_fold(spark: SparkSession, d: str) -> DataFrame:
    """Ordered fold per key as of a date: purchases add, errors reset, others leave the state alone.

    Resets make the fold two combinable aggregates: the last reset of each key,
    then the sum of what follows it. No key's events are gathered.
    """
    rows = table(spark, d, "events").where(F.col("ts") <= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    place = F.struct("ts", "event_id")
    last = rows.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "error", place)).alias("reset"), F.count("*").alias("chain"))
    bought = rows.where("event_type = 'purchase'").select("user_id", place.alias("at"), F.round(F.col("value") * 100).cast("long").alias("v"))
    after = bought.join(last.select("user_id", "reset"), "user_id").where("reset is null or at > reset").groupBy("user_id").agg(F.sum("v").alias("balance"))
    return last.join(after, "user_id", "left").select("user_id", F.coalesce("balance", F.lit(0).cast("long")).alias("balance"), "chain")


@reg.query("select event_id, user_id from events where ts <= timestamp '2024-01-10 00:00:00'")
def as_of_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("ts") <= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("event_id", "user_id")


@reg.query("select distinct 'order-' || cast(o_orderkey as varchar) as uid, 'Order' as type from orders union select distinct 'customer-' || cast(c_custkey as varchar), 'Customer' from customer")
def source_extract(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("uid"), F.lit("Order").alias("type"))
    c = table(spark, d, "customer").select(F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("uid"), F.lit("Customer").alias("type"))
    return o.unionByName(c).distinct()
