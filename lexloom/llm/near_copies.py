"""Operator 7 at five words and a similarity of 0.8: the pipeline's stage.

Two documents are near copies if their bags of five-word shingles (a shorter
text is one shingle, A-Z lower-cased) have a weighted Jaccard similarity of at
least 0.8. The n-th repeat of a shingle is an element of its own, so bags are
sets. Copies of one bag are one print.

1. SimHash: fingerprints are linked by operator 7's deletion-variant index, and
   each print is verified against the head of its component; those that pass are
   one root. That joins nearly all copies, clouds of thousands included.
2. The rest: 0.8 also allows fingerprints further apart than the index reaches,
   so pairs of different roots are completed by a prefix filter that loses none.
   Of n elements a near copy shares 4n/5 at least, so under one order of all
   elements the first n/5 + 1 of both meet. At the first element that two share,
   the places left on both sides bound what they can share; pairs below 0.8
   there, or by their sizes, go. The others are verified.

Each print carries a bitmap of its elements: a bit for each part of their range, set
if an odd number of them fall there. Bits that differ between two bitmaps come from
elements that only one bag has, so bags whose bitmaps differ in more than a ninth of
their elements can't reach 0.8. The joins that form pairs test that, so texts that
merely share a form (letters, licences) make no pairs. What is left is verified on the
whole texts, which a shuffle carries more cheaply than bags.
The order is that of the hashes, but the HOTTEST elements come last; which these
are changes the work, not the result. Buckets are contracted before pairs are made:
each member is verified against the bucket's least and greatest print, and what they
join has one root. In buckets of more than CROWDED prints only members outside the
largest component are then compared with the others.

Defined cases: null and wordless texts are copies of each other; rows with equal
or null ids are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.llm import op7_simhash
from lexloom.llm.common import FEW, byte_words, connected_components, materialize, reading, release, small_batches
from lexloom.llm.op7_simhash import simhash

SHINGLE = 5
#: Elements in more prefixes than this can be put last, so many of them at most; larger buckets are compared by component.
COMMON, HOTTEST, CROWDED = 3, 1_000_000, 48
#: 64-bit words of a bitmap.
BITMAP = 16
#: Prints that a task remembers, so as to write a copy once; elements it counts and writes at once; words it remembers.
REMEMBERED, COUNTED, EMITTED, WORDS = 200_000, 2_000_000, 100_000, 300_000


class WordHashes(dict):
    """xxh64 of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 42)
        return found


HASHES = WordHashes()


def hashes_of(text: str | None) -> np.ndarray:
    """64 bits of each five-word shingle, mixed from the words' hashes; of all words if they are fewer; zero for none."""
    words = byte_words(text)
    if not words:
        return np.zeros(1, np.uint64)
    of = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(of) - SHINGLE + 1)
    mixed = np.full(n, min(len(of), SHINGLE), np.uint64)
    for k in range(min(len(of), SHINGLE)):
        mixed = (mixed ^ of[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(32)


def bag(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct elements of a bag of hashes, as signed 64-bit numbers."""
    plain = np.sort(hashes.view(np.int64))
    again = plain[1:] == plain[:-1]
    if not again.any():
        return plain
    repeat = (np.arange(len(plain)) - np.searchsorted(plain, plain)).astype(np.uint64)
    return np.sort((plain.view(np.uint64) ^ (repeat * np.uint64(0x9E3779B97F4A7C15))).view(np.int64))


def print_of(made: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(made.tobytes()) - (1 << 63)


def bits_of(made: np.ndarray) -> np.ndarray:
    """Parities of a bag's elements by their low bits."""
    width = 64 * BITMAP
    return np.packbits(np.bincount(made & np.int64(width - 1), minlength=width) & 1).view(np.int64)


def could(x: str, y: str, n: str) -> Column:
    """Whether bags with these bitmaps and so many elements together may reach 0.8."""
    bits = " + ".join(f"bit_count({x}[{k}] ^ {y}[{k}])" for k in range(BITMAP))  # compiled, as a lambda is not
    return F.expr(f"({bits}) * 9 <= {n}")


@functools.lru_cache(256)
def bag_of(text: str | None) -> np.ndarray:
    """The bag of a text, remembered as a text's pairs come together."""
    return bag(hashes_of(text))


def prints_of(keyed: DataFrame) -> DataFrame:
    """(row, text) -> row, fp (of the bag), n, sim and bits; and, with null rows, elements of prefixes and how often a task met them.

    Of the elements those that a task meets twice or more are told, so few of them
    leave it; copies that it remembers count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0

        def out(rows, fps, sizes, sims, bits) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()) if isinstance(rows, list) else rows, pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sims, pa.int64()), pa.array(bits, pa.list_(pa.int64()))], ["row", "fp", "n", "sim", "bits"])

        def met() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            keys, n = keys[n > 1], n[n > 1].astype(np.int64)
            none = [None] * len(keys)
            return out(none, keys, none, n, none)

        for batch in batches:
            fps, sizes, sims, bits = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = hashes_of(text)
                made = bag(hashes)
                fp = print_of(made)
                fps.append(fp)
                bits.append(bits_of(made))
                sizes.append(len(made))
                sims.append(simhash(hashes))
                if fp not in seen:
                    if len(seen) < REMEMBERED:
                        seen.add(fp)
                    held.append(made[: len(made) // 5 + 1])
                    size += len(held[-1])
            yield out(batch.column(0), fps, sizes, sims, bits)
            if size > COUNTED:
                yield met()
                held, size = [], 0
        if held:
            yield met()

    return keyed.select("row", "text").mapInArrow(run, "row long, fp long, n int, sim long, bits array<bigint>")


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(fp, bag) of a task's texts, copies that it remembers left out."""
    seen: set[int] = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            made = bag(hashes_of(text))
            fp = print_of(made)
            if fp not in seen:
                if len(seen) < REMEMBERED:
                    seen.add(fp)
                yield fp, made


def hottest(told: DataFrame) -> np.ndarray:
    """The elements in most prefixes, sorted, from what ``prints_of`` tells of them."""
    counts = told.groupBy("fp").agg(F.sum("sim").alias("c")).where(F.col("c") > COMMON)
    return np.sort(np.array([r["fp"] for r in counts.orderBy(F.desc("c"), "fp").limit(HOTTEST).collect()], np.int64))


def prefixes(keyed: DataFrame, last: np.ndarray) -> DataFrame:
    """fp, n, and key and at (place) of the first n/5 + 1 elements; those of ``last`` come after all others."""
    sent = keyed.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = sent.value, [], 0

        def out() -> pa.RecordBatch:
            counts = [len(made) for _, _, made in held]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([fp for fp, _, _ in held], np.int64), counts)), pa.array(np.repeat(np.array([n for _, n, _ in held], np.int32), counts)), pa.array(np.concatenate([made for _, _, made in held])), pa.array(np.concatenate([np.arange(c, dtype=np.int32) for c in counts]))], ["fp", "n", "key", "at"])

        for fp, made in _once(batches):
            n = len(made)
            if len(last):
                made = made[np.argsort(last[np.minimum(np.searchsorted(last, made), len(last) - 1)] == made, kind="stable")]
            held.append((fp, n, made[: n // 5 + 1]))
            size += len(held[-1][2])
            if size > EMITTED:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return keyed.select("text").mapInArrow(run, "fp long, n int, key long, at int")


def _few(df: DataFrame) -> DataFrame:
    """A written table, ready for a join: broadcast if its rows are few, else left to a shuffle."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def similar(pairs: DataFrame, each: DataFrame, keyed: DataFrame, name: str) -> DataFrame:
    """Those pairs (a, b) of prints whose bags reach 0.8, by the texts of a row of each."""

    @F.pandas_udf("boolean")
    def reach(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y, strict=True):
            p, q = bag_of(s), bag_of(t)
            out.append(len(np.intersect1d(p, q, assume_unique=True)) * 9 >= (len(p) + len(q)) * 4)
        return pd.Series(out, dtype=bool)

    row = lambda side: each.select(F.col("fp").alias(side), F.col("row").alias(f"row_{side}"), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
    met = pairs.distinct().join(row("a"), "a").join(row("b"), "b")
    asked = materialize(met.where(could("bits_a", "bits_b", "(n_a + n_b)")).select("a", "b", "row_a", "row_b"), f"{name}-pairs")
    text = lambda side: keyed.join(rows[side] if few else _few(rows[side]), "row", "left_semi").select(F.col("row").alias(f"row_{side}"), F.col("text").alias(f"text_{side}"))
    few = asked.count() <= FEW
    rows = {side: asked.select(F.col(f"row_{side}").alias("row")).distinct() for side in "ab"}
    rows = {side: F.broadcast(of) if few else materialize(of, f"{name}-rows") for side, of in rows.items()}
    both = asked.join(text("a"), "row_a").join(text("b"), "row_b")
    out = materialize(both.where(reach("text_a", "text_b")).select("a", "b"), name)
    for used in (asked, *rows.values()):
        release(used)
    return out


def links(keyed: DataFrame, told: DataFrame) -> DataFrame:
    """Edges (a, b) of fps whose components are those of all near copies; ``told`` as of ``prints_of``."""
    prints = told.where("row is not null")
    # 1. SimHash: every print and the head of its fingerprint's component
    each = materialize(prints.groupBy("fp").agg(F.min("sim").alias("sim"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits")), "copies-each")
    joined = op7_simhash.components(each.select(F.col("sim").alias("fp")).distinct())
    of_root = materialize(each.join(joined, each.sim == joined.node, "left").select(each.fp, F.coalesce("root", "sim").alias("root")), "copies-of-root")
    heads = materialize(of_root.groupBy("root").agg(F.min("fp").alias("head")), "copies-heads")
    close = similar(of_root.join(heads, "root").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b")), each, keyed, "copies-close")
    release(of_root)
    release(heads)

    release(joined)

    # 2. pairs of different roots that meet in a prefix
    last = hottest(told.where("row is null"))
    index = prefixes(keyed, last).join(_few(close), F.col("fp") == F.col("b"), "left").select("key", "fp", "n", "at", F.coalesce("a", "fp").alias("root"))
    met = W.partitionBy("key")

    def apart(df: DataFrame) -> DataFrame:
        """Buckets whose members have more than one root."""
        two = df.withColumn("apart", F.min("root").over(met) != F.max("root").over(met))
        return materialize(two.where("apart").drop("apart"), "copies-shared")

    shared = apart(index.repartition("key").distinct().withColumn("c", F.count("*").over(met)).where(F.col("c") > 1))
    # stars first: a bucket's members against its least and its greatest, one pair a member, so that groups shrink to a root
    held = close
    for end in (F.min, F.max):
        pivot = shared.groupBy("key").agg(end(F.struct("fp", "n", "root")).alias("p"))
        star = shared.join(pivot, "key").where("root <> p.root and least(n, p.n) * 5 >= greatest(n, p.n) * 4").select(F.least("fp", "p.fp").alias("a"), F.greatest("fp", "p.fp").alias("b"))
        more = similar(star, each, keyed, "copies-stars")
        roots = connected_components(close.unionByName(more), "copies-contracted")
        wider, shared = shared, apart(shared.drop("root").join(_few(roots), F.col("fp") == F.col("node"), "left").select("key", "fp", "n", "at", "c", F.coalesce("root", "fp").alias("root")))
        for used in (held, more, wider):
            release(used)
        held, close = roots, roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    fits = "l.root <> r.root and least(l.n, r.n) * 5 >= greatest(l.n, r.n) * 4 and least(l.n - l.at, r.n - r.at) * 9 >= (l.n + r.n) * 4"
    # bitmaps join once for each member of a bucket, so that pairs which they rule out are never formed
    bare, shared = shared, materialize(shared.join(each.select("fp", "bits"), "fp"), "copies-members")
    release(bare)
    same, pair = F.expr(f"l.key = r.key and {fits}") & could("l.bits", "r.bits", "(l.n + r.n)"), [F.least("l.fp", "r.fp").alias("a"), F.greatest("l.fp", "r.fp").alias("b")]
    sparse, dense = shared.where(F.col("c") <= CROWDED), shared.where(F.col("c") > CROWDED)
    pairs = sparse.alias("l").join(sparse.alias("r"), same & F.expr("l.fp < r.fp")).select(*pair)
    largest = dense.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("largest"))
    outside = dense.join(largest, "key").where("root <> largest")
    pairs = pairs.unionByName(outside.alias("l").join(dense.alias("r"), same).select(*pair))
    far = similar(pairs, each, keyed, "copies-far")
    every = materialize(close.unionByName(far), "copies-links")
    for used in (each, held, shared, far):
        release(used)
    return every


def rooted(keyed: DataFrame) -> DataFrame:
    """(row, doc_id, text) -> row, doc_id, root: rows of one group share their root."""
    small_batches(keyed.sparkSession)
    prints = materialize(prints_of(keyed), "copies-prints")
    found = links(keyed, prints)
    roots = connected_components(found, "copies-components")
    flat = prints.where("row is not null").select("row", "fp").join(_few(roots), F.col("fp") == F.col("node"), "left").select("row", F.coalesce("root", "fp").alias("root"))
    out = materialize(flat.join(keyed.select("row", "doc_id"), "row"), "copies-rooted")
    for used in (prints, found, roots):
        release(used)
    return out


def near_copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, component_id (the least id), one row per input row."""
    keyed = materialize(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "copies-rows")
    found = rooted(keyed)
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) without near copies: of each group the row of least id stays (no id is last).

    Rows are told apart by a key of their own, written once, so repeated and null ids do no harm.
    """
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "copies-rows")
    found = rooted(keyed.select("row", "doc.doc_id", "doc.text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    stays = materialize(found.groupBy("root").agg(first.alias("first")).select("first.row"), "copies-stay")
    release(found)
    return reading(keyed.join(_few(stays), "row", "left_semi").select("doc.*"), keyed, stays)
