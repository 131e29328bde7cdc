"""Effective text of provisions: an ordered fold over amendments, as of one date or as a table of validity."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.link import AMENDMENT_TYPES


def _applied(acc: Column, a: Column) -> Column:
    """struct(txt, status) after one more amendment."""
    old, new, kind = F.coalesce(a["old_text"], F.lit("")), F.coalesce(a["new_text"], F.lit("")), a["rel_type"]
    has = (old != "") & F.contains(acc["txt"], old)
    swap = kind.isin("SUBSTITUTES", "DECRIMINALIZES")
    text = F.when(swap & has, F.replace(acc["txt"], old, new)).when(kind == "INSERTS", F.concat(acc["txt"], new)).when((kind == "OMITS") & has, F.replace(acc["txt"], old, F.lit(""))).otherwise(acc["txt"])
    return F.struct(text.alias("txt"), F.when(kind == "OMITS", "omitted").otherwise(acc["status"]).alias("status"))


def fold(original: Column, chain: Column) -> Column:
    """struct(current_text, status, amendment_chain, original_text).

    ``chain`` is an ordered array of structs with rel_type, old_text, new_text
    and effective_date. Substitutions replace every occurrence of a non-empty
    old text, insertions append, omissions delete and set the status for good;
    unknown types are skipped and leave no trace in the chain.
    """
    start = F.struct(F.coalesce(original, F.lit("")).alias("txt"), F.when(F.size(chain) > 0, "amended").otherwise("original").alias("status"))
    known = F.filter(chain, lambda a: a["rel_type"].isin(list(AMENDMENT_TYPES)))
    done = F.aggregate(known, start, _applied)
    return F.struct(done["txt"].alias("current_text"), done["status"].alias("status"), known.alias("amendment_chain"), original.alias("original_text"))


def effective_states(nodes: DataFrame, edges: DataFrame, as_of: datetime.date | None = None) -> DataFrame:
    """uid, number, state for every section at once."""
    when = F.lit(as_of) if as_of else F.current_date()
    dated = edges.where(F.col("rel_type").isin(list(AMENDMENT_TYPES))).where(F.col("effective_date") <= when)
    item = F.struct("effective_date", "seq", "src", "rel_type", "old_text", "new_text")
    chains = dated.groupBy(F.col("dst").alias("uid")).agg(F.array_sort(F.collect_list(item)).alias("chain"))
    none = F.array().cast(chains.schema["chain"].dataType)
    return nodes.where("label = 'Section'").select("uid", "number", "text").join(chains, "uid", "left").withColumn("chain", F.coalesce("chain", none)).select("uid", "number", fold(F.col("text"), F.col("chain")).alias("state"))


def validity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """uid, number, version, valid_from, valid_to, current_text, status of every state that a section has ever had.

    A state holds from ``valid_from`` (null: always before) to the day before
    ``valid_to`` (null: still); amendments of one day make one state. ``version`` is the
    number of amendments applied. One fold over a section's chain keeps all its states.
    """
    dated = edges.where(F.col("rel_type").isin(list(AMENDMENT_TYPES))).where(F.col("effective_date").isNotNull())
    item = F.struct("effective_date", "seq", "src", "rel_type", "old_text", "new_text")
    chains = dated.groupBy(F.col("dst").alias("uid")).agg(F.array_sort(F.collect_list(item)).alias("chain"))
    sections = nodes.where("label = 'Section'").select("uid", "number", F.coalesce("text", F.lit("")).alias("text")).join(chains, "uid", "left")
    state = "array<struct<day:date,txt:string,status:string>>"
    first = F.array(F.struct(F.lit(None).cast("date").alias("day"), F.col("text").alias("txt"), F.lit("original").alias("status"))).cast(state)

    def step(acc: Column, a: Column) -> Column:
        last = F.element_at(acc, -1)
        base = F.struct(last["txt"].alias("txt"), F.when(last["status"] == "original", "amended").otherwise(last["status"]).alias("status"))
        made = _applied(base, a)
        return F.concat(acc, F.array(F.struct(a["effective_date"].alias("day"), made["txt"].alias("txt"), made["status"].alias("status"))).cast(state))

    states = sections.select("uid", "number", F.aggregate(F.coalesce("chain", F.array().cast(chains.schema["chain"].dataType)), first, step).alias("s"))
    each = states.select("uid", "number", "s", F.posexplode("s").alias("version", "state")).withColumn("valid_to", F.get("s", F.col("version") + 1)["day"])
    kept = each.where(F.col("valid_to").isNull() | F.col("state.day").isNull() | (F.col("valid_to") > F.col("state.day")))
    return kept.select("uid", "number", "version", F.col("state.day").alias("valid_from"), "valid_to", F.col("state.txt").alias("current_text"), "state.status")


def as_of(pairs: DataFrame, states: DataFrame, days: int = 366) -> DataFrame:
    """pairs (uid, day, ...) with version, current_text and status as of that day; null for uids without a state.

    Days are cut into bins of ``days``: a state is repeated for each bin that it
    covers between the least and the greatest day asked for, so the join is one on
    (uid, bin) and neither a section with many states nor one that is asked for often
    meets all rows of the other side. Texts join afterwards, once for each pair.
    """
    bin_of = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    span = pairs.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if span["a"] is None:
        return pairs.join(states.select("uid", "version", "current_text", "status").limit(0), "uid", "left")
    low, high = (bin_of(F.lit(x)) for x in (span["a"], span["b"]))
    begin, end = F.coalesce(bin_of("valid_from"), low), F.coalesce(bin_of("valid_to"), high)
    covered = states.where((begin <= high) & (end >= low)).select("uid", "version", "valid_from", "valid_to", F.explode(F.sequence(F.greatest(begin, low), F.least(end, high))).alias("_bin"))
    asked = pairs.select("uid", "day").distinct().withColumn("_bin", bin_of("day"))
    met = asked.join(covered, ["uid", "_bin"]).where((F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("day"))) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))).select("uid", "day", "version")
    return pairs.join(met, ["uid", "day"], "left").join(states.select("uid", "version", "current_text", "status"), ["uid", "version"], "left")
