"""Benchmark decontamination, native: SimHash windows, Hamming blocks, exact check.

A document is contaminated by a benchmark item if some window of as many words
as the item has a weighted (multiset) Jaccard similarity of word shingles of at
least 0.8 with it; a text shorter than the item is one window as a whole. Words
are lower-cased; shingles have five words (an item of fewer words is one shingle).

1. Windows. A window that similar shares at least 8/9 of its shingles with the
   item, in whatever order. So shingles of documents are joined with those of
   the benchmark, and per document and item the distinct matched places are
   sorted. With m = ceil(8s/9) places needed of s, the window at a start holds m
   of them if some run of m consecutive matched places lies inside: the starts
   from the run's last place - s + 1 to its first place. All such starts, and no
   others, are windows, wherever parts of the item were moved to. A text of fewer
   than s shingles needs 4/5 s of them matched.
2. SimHash of every such window and of every item; RADIUS + 1 Hamming blocks of
   the 64 bits are indexed, and any two fingerprints within RADIUS share a block.
3. Pairs within RADIUS are verified by the exact similarity.

All of this is keyed by the text's digest, so copies of one text are one, and
ids, null or repeated, play no part in it; at the end rows find their text's items.

The benchmark's shingles and blocks are broadcast only if they are proven to be
at most BROADCAST. A larger benchmark's joins shuffle, but only the shingles that
pass a bitmap of its hashes (2^PARTS words of 64 bits, so its size is bounded).

Defined cases: null and empty texts and items never match; null item or
document ids are reported like others; repeated rows and items count once for
each id; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import let, materialize, reading, release_read, words_of

WORDS, SIMILAR, RADIUS = 5, 0.8, 20
BROADCAST, PARTS = 1_000_000, 19
#: Start that stands for a whole text with fewer shingles than the item.
WHOLE = -1


def shingle_hashes(words: Column, k: int) -> Column:
    """xxhash64 of every run of k words."""
    return let(words, lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>")))


def lowered(text: Column) -> Column:
    return words_of(F.lower(text))


def fingerprint(hashes: Column) -> Column:
    """SimHash: a bit is set if it is in over half of the hashes."""
    bits = list(range(64))
    return let(hashes, lambda h: F.aggregate(F.lit(bits), F.lit(0).cast("long"), lambda acc, b: F.when(F.aggregate(h, F.lit(0), lambda c, x: c + F.getbit(x, b).cast("int")) * 2 > F.size(h), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc)))


def blocks(fp: Column) -> Column:
    """RADIUS + 1 pieces of a fingerprint, each with its number above its bits."""
    n, out, at = RADIUS + 1, [], 0
    for k in range(n):
        width = 64 // n + (k < 64 % n)
        out.append(F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1).bitwiseOR(F.lit(k << 8).cast("long")).cast("int"))
        at += width
    return F.array(*out)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags of hashes."""
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    shared = F.aggregate(F.array_distinct(b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return let(shared, lambda s: s / (F.size(a) + F.size(b) - s))


def starts_of(places: Column, s: Column) -> Column:
    """WHOLE, and each start whose window of s places holds at least 8s/9 of the sorted places."""
    need = F.ceil(s * 8 / 9).cast("int")
    # of the run's starts, those after the place before it: each start comes once
    run = lambda i: let(F.get(places, i + need - 1) - s + 1, lambda low: F.when(low <= F.get(places, i), F.sequence(F.greatest(low, F.coalesce(F.get(places, i - 1) + 1, F.lit(0)), F.lit(0)), F.get(places, i))).otherwise(F.array().cast("array<int>")))
    runs = F.when(F.size(places) >= need, F.transform(F.sequence(F.lit(0), F.size(places) - need), run)).otherwise(F.array().cast("array<array<int>>"))
    return F.concat(F.array(F.lit(WHOLE)), F.flatten(runs))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), k (words in a shingle), s (shingles), hashes, item_fp; items without words are left out."""
    split = benchmark.select("item_id", lowered(F.col("text")).alias("w")).where(F.size("w") > 0).select("item_id", F.size("w").alias("n"), F.least(F.size("w"), F.lit(WORDS)).alias("k"), "w")
    by_size = F.coalesce(*[F.when(F.col("k") == k, shingle_hashes(F.col("w"), k)) for k in range(1, WORDS + 1)])
    return split.select("item_id", "n", "k", by_size.alias("hashes")).distinct().select("*", F.size("hashes").alias("s"), fingerprint(F.col("hashes")).alias("item_fp"))


def _passing(hashes: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``hashes`` whose hash may be in ``index``: its bit in the bitmap of the index is set."""
    part, bit = F.expr(f"shiftrightunsigned(hash, {64 - PARTS})"), F.call_function("shiftleft", F.lit(1).cast("long"), F.expr(f"cast(shiftrightunsigned(hash, {58 - PARTS}) & 63 as int)"))
    bitmap = index.select(part.alias("part"), bit.alias("bit")).groupBy("part").agg(F.bit_or("bit").alias("bits"))
    return hashes.withColumn("part", part).join(F.broadcast(bitmap), "part").where(F.col("bits").bitwiseAND(bit) != 0).drop("part", "bits")


def _digest() -> Column:
    return F.md5("text").alias("t")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (text), benchmark (item_id, text) -> t (digest of the text), item_id, similarity, hamming, start; one row a pair."""
    items = materialize(items_of(benchmark), "bench-items")
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most WORDS values
    held = items.agg(F.coalesce(F.sum(F.col("s") + RADIUS + 1), F.lit(0))).first()[0]
    few = held <= BROADCAST
    small = F.broadcast if few else (lambda df: df)
    index = items.select("item_id", "n", "k", "s", F.explode(F.array_distinct("hashes")).alias("hash"))
    words = docs.where("text is not null").select(_digest(), lowered(F.col("text")).alias("w"))
    hits = None
    for k in sizes:
        made, of_size = words.select("t", F.posexplode(shingle_hashes(F.col("w"), k)).alias("p", "hash")), index.where(F.col("k") == k).drop("k")
        found = (made if few else _passing(made, of_size)).join(small(of_size), "hash").select("t", "item_id", "n", F.lit(k).alias("k"), "s", "p")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return docs.sparkSession.createDataFrame([], f"t string, item_id {dict(benchmark.dtypes)['item_id']}, similarity double, hamming int, start int")
    places = hits.groupBy("t", "item_id", "n", "k", "s").agg(F.array_sort(F.collect_set("p")).alias("places")).where(F.size("places") * 5 >= F.col("s") * 4)
    starts = materialize(places.select("t", "n", "k", "s", F.explode(starts_of(F.col("places"), F.col("s"))).alias("start")).groupBy("t", "n", "k", "s").agg(F.array_sort(F.collect_set("start")).alias("starts")), "bench-starts")
    texts = _bounded(starts.select("t").distinct())
    some = docs.select(_digest(), "text").join(texts, "t", "left_semi").dropDuplicates(["t"])
    wanted = some.join(starts, "t").select("t", "n", "k", "s", "starts", lowered(F.col("text")).alias("w"))
    hashed = wanted.select("t", "n", "k", "s", "starts", F.coalesce(*[F.when(F.col("k") == k, shingle_hashes(F.col("w"), k)) for k in sizes]).alias("all"))
    fits = lambda x: F.when(x == WHOLE, F.size("all").between(F.ceil(F.col("s") * 4 / 5), F.col("s") - 1)).otherwise(x + F.col("s") <= F.size("all"))
    windows = hashed.select("t", "n", "k", "s", F.explode(F.transform(F.filter("starts", fits), lambda x: F.struct(F.greatest(x, F.lit(0)).alias("start"), F.slice("all", F.greatest(x, F.lit(0)) + 1, F.col("s")).alias("hashes")))).alias("x")).select("t", "n", "k", "s", "x.*")
    printed = materialize(windows.withColumn("fp", fingerprint(F.col("hashes"))), "bench-windows")
    release_read(texts)
    blocked = items.select("item_id", "n", "hashes", "item_fp", F.explode(blocks(F.col("item_fp"))).alias("block")).withColumnRenamed("hashes", "item_hashes")
    near = F.expr(f"bit_count(fp ^ item_fp) <= {RADIUS}")
    # a pair of fingerprints meets in each block that they share; the first one reports it
    first = F.array_position(F.zip_with(blocks(F.col("fp")), blocks(F.col("item_fp")), lambda x, y: x == y), F.lit(True)) - 1 == F.shiftright("block", 8)
    met = printed.withColumn("block", F.explode(blocks(F.col("fp")))).join(small(blocked), ["n", "block"]).where(near & first)
    exact = met.select("t", "item_id", "start", similarity(F.col("hashes"), F.col("item_hashes")).alias("similarity"), F.expr("cast(bit_count(fp ^ item_fp) as int)").alias("hamming")).where(F.col("similarity") >= SIMILAR)
    return reading(exact.groupBy("t", "item_id").agg(_best()).select("t", "item_id", "best.*"), items, starts, printed)


def _best() -> Column:
    return F.max_by(F.struct("similarity", "hamming", "start"), F.struct("similarity", -F.col("hamming"), -F.col("start"))).alias("best")


def _bounded(df: DataFrame) -> DataFrame:
    """Ready for a join: broadcast if its rows are few, else left to a shuffle."""
    held = materialize(df, "bench-bounded")
    release_read(df)
    return reading(F.broadcast(held) if held.limit(BROADCAST + 1).count() <= BROADCAST else held, held)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> doc_id, item_id, similarity, hamming, start; one row a pair."""
    found = docs.select("doc_id", _digest()).join(_bounded(leaks(docs, benchmark)), "t")
    return found.groupBy("doc_id", "item_id").agg(_best()).select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (text, ...) without the rows whose text holds an item of the benchmark (item_id, text)."""
    every = leaks(docs, benchmark)
    found = _bounded(reading(every.select("t").distinct(), *getattr(every, "_lexloom_reads", ())))
    out = docs.select(F.struct(*docs.columns).alias("doc"), _digest()).join(found, "t", "left_anti").select("doc.*")
    return reading(out, *found._lexloom_reads)
