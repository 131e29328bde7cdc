"""Near duplicates by SimHash, with one-wildcard segment variants as index.

A 64-bit fingerprint is cut into three segments (22, 21 and 21 bits). If two
fingerprints differ in at most four bits, the three segments share those four
bits, so at least one segment differs in at most one bit: both fingerprints
then own the variant of that segment in which the differing bit is a wildcard.
Each fingerprint is indexed under its 64 one-wildcard variants, the index is
self-joined on equality, and the Hamming distance is verified on the full bits.

Buckets that hold a cloud of near copies would make that join quadratic. They
are contracted first: members within four bits of their bucket's least
fingerprint, and members one bit apart, are linked at once. After that only
members outside their bucket's largest component are compared with the others,
and only with those that agree on one of five pieces of the bits outside the
segment: at most four bits differ, so some piece agrees. A crowd of unrelated
fingerprints so shrinks by 2^8 at five rows a member. No link between different
components is lost and no pair list is emitted.

Defined cases: null and blank texts have fingerprint zero and link like others;
repeated rows stay (one output row per input row); a component whose ids are
all null has a null component_id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import byte_words, connected_components, materialize, release, small_batches

RADIUS, SEED = 4, 42
#: (first bit, width) of the three segments, from the low end.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket with more distinct fingerprints than this is contracted first.
CROWDED = 48
#: Index rows that one task makes.
ROWS_A_TASK = 1_000_000


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """xxh64 of each run of so many words; of all of them if they are fewer."""
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a bag of hashes; zero for none."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        octets = hashes[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8)
        # Byte-wise sums of at most 255 rows can't overflow into their neighbour's byte.
        packed = np.unpackbits(octets, axis=1).view(np.uint64)
        counts += np.add.reduceat(packed, np.arange(0, len(packed), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = 4) -> Column:
    @F.pandas_udf("long")
    def of_texts(texts: pd.Series) -> pd.Series:
        split = map(byte_words, texts)
        return pd.Series([simhash(shingle_hashes(w, shingle)) if w else 0 for w in split], dtype="int64")

    return of_texts(text)


def _variants(fp: str = "fp") -> Column:
    """The 64 index keys of a fingerprint: segment and wildcard bit above, the other bits below."""
    made = []
    for s, (at, width) in enumerate(SEGMENTS):
        piece = f"(shiftrightunsigned({fp}, {at}) & {(1 << width) - 1}L)"
        made += [F.expr(f"{piece} & {((1 << width) - 1) ^ (1 << j)}L | {(s << 5 | j) << 32}L") for j in range(width)]
    return F.array(*made)


def _first_shared(a: str, b: str) -> Column:
    """The first variant that two fingerprints share: of all, exactly one bucket reports a pair."""
    case = "case "
    for s, (at, width) in enumerate(SEGMENTS):
        diff = f"(shiftrightunsigned({a} ^ {b}, {at}) & {(1 << width) - 1}L)"
        key = f"(shiftrightunsigned({a}, {at}) & {(1 << width) - 1}L)"
        bit = f"(case when {diff} = 0 then 1L else {diff} end)"
        case += f"when bit_count({diff}) <= 1 then ({key} & ({(1 << width) - 1}L ^ {bit})) | ((bit_count({bit} - 1L) | {s << 5}L) * {1 << 32}L) "
    return F.expr(case + "end")


def _pieces() -> Column:
    """RADIUS + 1 numbered pieces of the bits outside the segment that ``key`` stands for."""
    rest = "case shiftright(key, 37) when 0 then shiftrightunsigned(fp, 22) when 1 then (fp & 4194303L) | shiftleft(shiftrightunsigned(fp, 43), 22) else fp & 8796093022207L end"
    return F.array(*[F.expr(f"cast(shiftrightunsigned({rest}, {9 * k}) & 511L as int) | {k << 9}") for k in range(RADIUS + 1)])


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within RADIUS bits; a table, to be released.

    ``prints`` has one column fp of distinct fingerprints.
    """
    spark, prints = prints.sparkSession, materialize(prints, "simhash-distinct")
    # 64 rows come of each: spread them first, as few small files would be few tasks
    parts = max(spark.sparkContext.defaultParallelism, -(-prints.count() * 64 // ROWS_A_TASK))
    index = materialize(prints.repartition(parts, "fp").select("fp", F.explode(_variants()).alias("key")), "simhash-index")
    sizes = index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("pivot"))
    crowded = materialize(sizes.where(F.col("n") > CROWDED), "simhash-crowded")
    near = F.expr(f"bit_count(l.fp ^ r.fp) <= {RADIUS}")
    if not crowded.take(1):
        found = materialize(index.alias("l").join(index.alias("r"), (F.col("l.key") == F.col("r.key")) & F.expr("l.fp < r.fp") & near & (F.col("l.key") == _first_shared("l.fp", "r.fp"))).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")), "simhash-links")
        for used in (prints, index, crowded):
            release(used)
        return found
    # Sparse buckets: all pairs. Crowded buckets: stars first, then what stars left apart.
    sparse = index.join(crowded.select("key"), "key", "left_anti")
    edges = sparse.alias("l").join(sparse.alias("r"), (F.col("l.key") == F.col("r.key")) & F.expr("l.fp < r.fp") & near).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).distinct()
    dense = materialize(index.join(crowded.select("key", "pivot"), "key"), "simhash-dense")
    stars = dense.where(f"fp <> pivot and bit_count(fp ^ pivot) <= {RADIUS}").select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct()
    members = dense.select("fp").distinct()
    bits = members.select("fp", F.explode(F.array(*[F.expr(f"fp & {~(1 << j) if j < 63 else (1 << 63) - 1}L") for j in range(64)])).alias("rest"), F.lit(1).alias("one"))
    steps = bits.where("rest <> fp").join(members.select(F.col("fp").alias("rest")), "rest", "left_semi").select(F.col("fp").alias("a"), F.col("rest").alias("b"))
    edges = materialize(edges.unionByName(stars).unionByName(steps), "simhash-edges")
    roots = connected_components(edges, "simhash-contracted")
    placed = materialize(dense.join(roots, dense.fp == roots.node, "left").select("key", "fp", F.coalesce("root", "fp").alias("root")), "simhash-placed")
    largest = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
    outside = placed.join(largest, "key").where("root <> largest").select("key", "fp", "root")
    outside, inside = (df.select("key", "fp", "root", F.explode(_pieces()).alias("piece")) for df in (outside, placed))
    more = outside.alias("l").join(inside.alias("r"), F.expr("l.key = r.key and l.piece = r.piece and l.root <> r.root") & near).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).distinct()
    every = materialize(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), "simhash-links")
    for used in (prints, index, crowded, dense, edges, roots, placed):
        release(used)
    return every


def components(prints: DataFrame) -> DataFrame:
    """prints (fp, distinct) -> node, root: the fingerprints that have links, and the least one reachable."""
    found = links(prints)
    roots = connected_components(found, "simhash-components")
    release(found)
    return roots


def near_duplicates(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint, component_id, one row per input row."""
    small_batches(docs.sparkSession)
    rows = materialize(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")), "simhash-prints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-least")
    roots = components(prints.select("fp"))
    # tables of their own on both sides: a component of many fingerprints can be split in the join
    groups = materialize(prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-groups")
    ids = materialize(groups.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    by_print = materialize(groups.join(ids, "root").select("fp", "component_id"), "simhash-by-print")
    for used in (prints, roots, groups, ids):
        release(used)
    return rows.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
