"""Graph operators on node and edge tables: upserts, endpoint checks, dedupe, ranks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.tables import materialize, release

#: Nodes without a parent by design.
ROOTS = ("Act", "RuleSet", "AmendmentAct")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def collect_children(children: DataFrame, parent: str, key: str, name: str) -> DataFrame:
    """Children's keys of each parent in order, joined by ``|``; aggregated before any join."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), "|")
    return children.groupBy(parent).agg(joined.alias(name))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to."""
    return nodes.join(edges.select(F.col("dst").alias("uid")), "uid", "left_anti")


def walk(nodes: DataFrame) -> DataFrame:
    """uid, root, depth, state of each node by its chain of parents; of repeated uids the least parent counts.

    The state is ``reached``, ``lost`` (a parent is missing) or ``cycle`` (the chain
    never ends); root and depth are null but for ``reached``. Pointers are doubled: a
    round replaces what a node points to by what that points to, so chains of n nodes
    take log2(n) rounds, and a round joins only nodes that are still on their way.
    What none of a round reaches lies on or below a cycle. Only nodes that are some
    node's parent take part in the rounds; all get what their parent has at the end.
    """
    every = materialize(nodes.groupBy("uid").agg(F.min("parent").alias("at")), "walk-nodes")
    own = every.join(every.select(F.col("at").alias("uid")).distinct(), "uid", "left_semi")
    ended = F.col("at").isNull()
    now = materialize(own.select("uid", "at", F.when(ended, F.lit(0)).otherwise(1).cast("long").alias("depth"), F.when(ended, F.col("uid")).alias("root"), F.when(ended, "reached").alias("state")), "walk")
    while True:
        on, there = now.where("state is null"), now.select(F.col("uid").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("root").alias("top"), F.col("state").alias("then"))
        step = on.drop("root", "state").join(there, "at", "left")
        state = F.when(F.col("more").isNull(), "lost").otherwise(F.col("then"))
        moved = step.select("uid", F.when(state.isNull(), F.col("next")).alias("at"), F.when(F.coalesce(state != "lost", F.lit(True)), F.col("depth") + F.col("more")).alias("depth"), F.when(state == "reached", F.col("top")).alias("root"), state.alias("state"))
        after = materialize(now.where("state is not null").unionByName(moved), "walk")
        left = [df.where("state is null").count() for df in (now, after)]
        release(now)
        now = after
        if left[0] == left[1]:
            break
    above = now.select(F.col("uid").alias("at"), F.col("root").alias("top"), F.col("depth").alias("more"), F.coalesce("state", F.lit("cycle")).alias("then"))
    state = F.when(F.col("at").isNull(), "reached").otherwise(F.coalesce("then", F.lit("lost")))
    root = F.when(F.col("at").isNull(), F.col("uid")).when(F.col("then") == "reached", F.col("top"))
    depth = F.when(F.col("at").isNull(), F.lit(0)).when(F.col("then") == "reached", F.col("more") + 1)
    return every.join(above, "at", "left").select("uid", root.alias("root"), depth.cast("int").alias("depth"), state.alias("state"))


def ancestor_headers(nodes: DataFrame, header: Column) -> DataFrame:
    """uid, path: headers of its ancestors, outermost first, by doubled pointers as in ``walk``.

    A missing parent ends the path; nodes on or below a cycle have none (null).
    """
    now = materialize(nodes.groupBy("uid").agg(F.min("parent").alias("at"), F.min(header).alias("header")).withColumn("path", F.array().cast("array<string>")), "paths")
    while True:
        on, there = now.where("at is not null"), now.select(F.col("uid").alias("at"), F.col("at").alias("next"), F.col("path").alias("above"), F.array_compact(F.array("header")).alias("own"))
        moved = on.join(there, "at", "left").select("uid", F.col("next").alias("at"), "header", F.when(F.col("own").isNull(), F.col("path")).otherwise(F.concat("above", "own", "path")).alias("path"))
        after = materialize(now.where("at is null").unionByName(moved), "paths")
        left = [df.where("at is not null").count() for df in (now, after)]
        release(now)
        now = after
        if left[0] == left[1]:
            break
    return now.select("uid", F.when(F.col("at").isNull(), F.col("path")).alias("path"))


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_wins(df: DataFrame, keys: Sequence[str], seq: str, columns: Sequence[str]) -> DataFrame:
    """One row a key with the values of the greatest seq: a combinable aggregate, no sort."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), seq).alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in columns])


def upsert_nodes(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("label", "uid")) -> DataFrame:
    """Merge by key: a later non-null property overwrites an earlier one."""
    new = last_property_wins(new, keys)
    cols = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    has = set(new.columns)
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys], *[(F.coalesce(f"b.{c}", f"a.{c}") if c in has else F.col(f"a.{c}")).alias(c) for c in cols])


def last_property_wins(df: DataFrame, keys: Sequence[str], ord_column: str = "ord") -> DataFrame:
    """Rows of one key folded to one: the last non-null value of each property by ord."""
    if ord_column not in df.columns:
        raise ValueError(f"rows of one key need the order column {ord_column}")
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ord_column))).alias(c) for c in cols])


def upsert_edges(nodes: DataFrame, edges: DataFrame, allowed: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges to keep, rejected edges): type allowed, both ends exist, one edge for (src, rel_type, dst).

    Of repeated edges with properties the last by seq stays.
    """
    uids = nodes.select("uid").distinct()
    typed = edges.where(F.col("rel_type").isin(list(allowed))) if allowed is not None else edges
    ends = typed.join(uids.withColumnRenamed("uid", "src"), "src", "left_semi").join(uids.withColumnRenamed("uid", "dst"), "dst", "left_semi")
    keys = ["src", "rel_type", "dst"]
    rest = [c for c in edges.columns if c not in keys]
    kept = last_wins(ends, keys, "seq", rest) if "seq" in edges.columns else ends.dropDuplicates(keys)
    rejected = edges.where(~F.col("rel_type").isin(list(allowed))) if allowed is not None else edges.limit(0)
    return kept.select(edges.columns), rejected


def assert_unique(nodes: DataFrame, keys: Sequence[str] = ("label", "uid")) -> None:
    """Uniqueness constraint: raises with examples if a key repeats."""
    twice = nodes.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"not unique: {[tuple(r)[:-1] for r in twice]}")


def limited(df: DataFrame, most: int = 25) -> DataFrame:
    """Bound a listing; callers leave plans with a limit or aggregate of their own alone."""
    return df.limit(most)


def with_duplicate_suffix(df: DataFrame, name: str, pos: str, out: str = "uid") -> DataFrame:
    """``name-dup-k`` for a repeated name, k being the number of rows before it.

    The global ordinal comes from a range partitioning: counts of each range
    (a row a range) give its offset, the number inside a range is local.
    """
    ranged = df.withColumn("_range", F.lit(0)) if df.isEmpty() else _with_range(df, pos)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    k = F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(pos)) - 1
    numbered = ranged.join(F.broadcast(before), "_range").withColumn("_k", k)
    again = F.row_number().over(W.partitionBy(name).orderBy(pos)) > 1
    return numbered.withColumn(out, F.when(again, F.concat(F.col(name), F.lit("-dup-"), F.col("_k").cast("string"))).otherwise(F.col(name))).drop("_range", "_before", "_k")


def _with_range(df: DataFrame, pos: str, ranges: int = 256) -> DataFrame:
    """A number of the range of pos; bounds are approximate quantiles, at most ``ranges`` of them."""
    cuts = df.agg(F.percentile_approx(pos, [i / ranges for i in range(1, ranges)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    # position of pos among the cuts, as a count of the cuts below it
    return df.withColumn("_range", F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(pos))) if cuts else F.lit(0))


def nearest_rank(df: DataFrame, key: str, value: str, quantiles: dict[str, float], band: float = 0.005) -> DataFrame:
    """Values at index int(n * q) of each key's sorted values, exactly.

    An approximate percentile brackets each wanted rank; rows below the bracket
    are only counted, and only the rows inside it (about twice ``band`` of all)
    are put in order. Few keys with many rows so never sort in one task.
    """
    names = list(quantiles)
    probes = [min(max(q + d, 0.0), 1.0) for q in quantiles.values() for d in (-band, band)]
    rough = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.percentile_approx(value, probes, 10_000).alias("at"), F.min(value).alias("least"), F.max(value).alias("most"))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.col("n") * q), F.col("n") - 1).alias("rank"), (F.col("least") if q <= band else F.col("at")[2 * k]).alias("low"), (F.col("most") if q >= 1 - band else F.col("at")[2 * k + 1]).alias("high")) for k, (name, q) in enumerate(quantiles.items())])
    brackets = rough.select(key, "n", F.explode(wanted).alias("w")).select(key, "n", "w.*")  # a row a key and quantile
    met = df.select(key, value).join(brackets, key).where(F.col(value) <= F.col("high"))
    below = F.col(value) < F.col("low")
    counts = met.groupBy(key, "name", "rank", "n", F.when(~below, F.col(value)).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(key, "name").orderBy(F.asc_nulls_first("v")))
    found = counts.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & F.col("v").isNotNull())
    return found.groupBy(key).agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in names], F.max("n").alias("n"))
