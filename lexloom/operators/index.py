"""A stored full-text index that is kept current by segments and read by blocks.

A batch of nodes becomes one segment: the term counts of its documents, in order of
length within each task, their terms in blocks of neighbouring documents, and pieces
of its terms. Terms are counted in their row and blocks are formed in the task that
holds their documents, so neither texts nor postings are shuffled; only uids, distinct
terms and their pieces are. What a batch replaces or removes stays where it is and is
marked in the new segment, so a batch writes its own rows and reads no more than the
buckets of its uids. Counts of documents and terms subtract what is marked (a search
looks for it in the blocks of marked documents alone), so scores are those of an index
built anew. ``merge`` joins small segments and drops what is marked. The newest
complete manifest names the segments; a replayed batch writes its segment again and is
named once.

A search reads the heads of its terms' blocks first: with the greatest frequency and
the least length in a block, no document in it scores more than a bound. Blocks are
read in falling order of their bounds summed over the terms, until the bounds fall
below the score of the last of the best documents so far (MaxScore over blocks), so
the rows are those of a full scan while few blocks are read.

Fuzzy words are looked up by pieces: of k + 1 pieces of a term one stands unchanged in
each word within k edits, at most k places off, so only rows of the word's own pieces
are read, never all terms.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.functions.vocabulary import MOST_EDITS
from lexloom.operators.graph import union_all
from lexloom.operators.search import K1, TOP, B, tokens
from lexloom.session import workers_import
from lexloom.tables import materialize, release

FIELDS = ("text", "title", "term")
#: Parts of a segment, files that a part may have, documents in a block (as a power of two).
PARTS, SLICES, BLOCK_BITS = 64, 16, 7
#: Postings that a task sorts by term at once, block rows and documents that it hands over at once.
RUN, ROWS, DOCS = 2_000_000, 32_768, 1_000
#: Columns of a segment's tables; ``of`` is the segment that a mark is about.
TABLES = {
    "counts": "uid string, dl int, counts array<struct<term:string,tf:int>>, doc long",
    "docs": "uid string, dl int, doc long, bucket int",
    "blocks": "term string, block long, n int, most_tf int, least_dl int, docs array<struct<doc:bigint,tf:int,dl:int>>",
    "words": "term string, piece long, part int",
    "gone": "of string, doc long, dl int, bucket int",
    "size": "n long, tokens long",
}
#: Blocks of the first rounds of a search; the last round reads all that can still matter.
ROUNDS = (16, 256)
#: Segments before they are merged.
MOST_SEGMENTS = 8


def counted(terms: str) -> tuple[Column, Column]:
    """(places where a term of the sorted array column begins, the terms' counts by the column ``begins`` of these places)."""
    all_of = F.col(terms)
    begins = F.filter(F.transform(all_of, lambda t, i: F.when((i == 0) | (F.get(all_of, i - 1) != t), i)), lambda i: i.isNotNull())
    until = lambda k: F.coalesce(F.get(F.col("begins"), k + 1), F.size(all_of))
    return begins, F.transform("begins", lambda i, k: F.struct(F.get(all_of, i).alias("term"), (until(k) - i).alias("tf")))


def _run(parts: list[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of some documents, in order of their terms."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    lists = rows["counts"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    each, many = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    if not len(each):
        return
    terms = each.field("term").dictionary_encode()
    order = pc.sort_indices(terms.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    term, doc, dl, tf = rank[terms.indices.to_numpy()], np.repeat(rows["doc"].to_numpy(), many), np.repeat(rows["dl"].to_numpy(), many), each.field("tf").to_numpy()
    at = np.lexsort((doc, term))
    term, doc, dl, tf = term[at], doc[at], dl[at], tf[at]
    block = doc >> bits
    start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
    ends = np.r_[start, len(doc)]
    most, least, names = np.maximum.reduceat(tf, start), np.minimum.reduceat(dl, start), pa.array(order[term[start]])
    for a in range(0, len(start), ROWS):
        b = min(a + ROWS, len(start))
        held = slice(ends[a], ends[b])
        docs = pa.StructArray.from_arrays([pa.array(doc[held]), pa.array(tf[held]), pa.array(dl[held])], ["doc", "tf", "dl"])
        columns = [terms.dictionary.take(names[a:b]), pa.array(block[start[a:b]]), pa.array(np.diff(ends[a : b + 1]).astype(np.int32)), pa.array(most[a:b]), pa.array(least[a:b]), pa.ListArray.from_arrays(pa.array((ends[a : b + 1] - ends[a]).astype(np.int32)), docs)]
        yield pa.RecordBatch.from_arrays(columns, ["term", "block", "n", "most_tf", "least_dl", "docs"])


def _in_blocks(bits: int):
    """Batches of documents (doc, dl, counts) -> blocks; a task holds about RUN postings at once."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch["counts"].flatten())
            if n >= RUN:
                yield from _run(held, bits)
                held, n = [], 0
        if held:
            yield from _run(held, bits)

    return made


def _cuts(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, length) of a term's pieces; a term of n characters is near words within n - 1 edits at most."""
    k = min(edits, length - 1) + 1
    return [(j * length // k, (j + 1) * length // k - j * length // k) for j in range(k)]


def pieces(term: Column) -> Column:
    """Hashes of a term's pieces with the term's length and the piece's number."""
    n = F.length(term)
    of = lambda k: F.array(*[F.xxhash64(n, F.lit(j), F.substring(term, F.floor(n * j / k).cast("int") + 1, (F.floor(n * (j + 1) / k) - F.floor(n * j / k)).cast("int"))) for j in range(k)])
    out = of(MOST_EDITS + 1)
    for k in range(MOST_EDITS, 0, -1):
        out = F.when(n <= k, of(k)).otherwise(out)
    return out


def _asked_pieces(word: str) -> set[tuple[int, int, str]]:
    """(length, number, piece) of all terms that could be near the word."""
    lengths = range(max(1, len(word) - MOST_EDITS), len(word) + MOST_EDITS + 1)
    return {(n, j, word[a : a + size]) for n in lengths for j, (start, size) in enumerate(_cuts(n, MOST_EDITS)) for a in range(max(0, start - MOST_EDITS), start + MOST_EDITS + 1) if a + size <= len(word)}


@dataclass(frozen=True)
class Found:
    """The best documents (uid, score), and how many of the terms' blocks were read for them."""

    rows: list[tuple[str, float]]
    blocks: int
    blocks_read: int


class Index:
    """One index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, fields: Sequence[str] = FIELDS, parts: int = PARTS, block_bits: int = BLOCK_BITS):
        self.spark, self.path, self.fields, self.parts, self.bits = spark, path.rstrip("/"), tuple(fields), parts, block_bits

    # ---- which segments there are

    def _versions(self) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath() for f in fs.listStatus(where)] if fs.exists(where) else []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(done(f"{p.toString()}/_SUCCESS")))

    def segments(self, version: int | None = None) -> list[str]:
        """Names of the segments, oldest first; none if there is no index."""
        found = self._versions() if version is None else [version]
        if not found:
            return []
        return [r["segment"] for r in self.spark.read.parquet(f"{self.path}/manifest/v={found[-1]}").orderBy("place").collect()]

    def _name(self, segments: list[str]) -> None:
        version = (self._versions() or [0])[-1] + 1
        rows = self.spark.createDataFrame(list(enumerate(segments)), "place int, segment string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        self._forget(version)

    def _forget(self, version: int) -> None:
        """Deletes segments that neither this manifest nor the one before names."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        where = path(f"{self.path}/segments")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        kept = {s for v in self._versions()[-2:] for s in self.segments(v)}
        for f in fs.listStatus(where):
            if f.getPath().getName() not in kept:
                fs.delete(f.getPath(), True)

    def _read(self, table: str, segments: Sequence[str]) -> DataFrame:
        return union_all([self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/segments/{s}/{table}").withColumn("segment", F.lit(s)) for s in segments])

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    # ---- writing

    def upsert(self, nodes: DataFrame, removed: DataFrame | None = None, name: str | None = None) -> None:
        """Adds nodes, in place of older ones of their uids, and takes out the uids of ``removed``.

        Of repeated uids the greatest text counts. A batch of a known ``name`` is skipped.
        """
        known, name = self.segments(), name or f"s{uuid.uuid4().hex}"
        if name in known:
            return
        body = nodes.select("uid", F.concat_ws(" ", *self.fields).alias("body"))
        if not nodes.groupBy("uid").count().where("count > 1").isEmpty():
            body = body.groupBy("uid").agg(F.max("body").alias("body"))
        said = body.select("uid", F.sort_array(tokens(F.coalesce("body", F.lit("")))).alias("said"))
        begins, counts = counted("said")
        docs = said.withColumn("begins", begins).select("uid", F.size("said").alias("dl"), counts.alias("counts"))
        changed = nodes.select("uid") if removed is None else nodes.select("uid").unionByName(removed.select("uid"))
        self._write(name, docs, self._replaced(changed.distinct(), known))
        self._name([*known, name])

    def _replaced(self, uids: DataFrame, known: list[str]) -> DataFrame | None:
        """of (segment), doc, dl, bucket: the live documents of the uids."""
        if not known:
            return None
        touched = [r[0] for r in uids.select(self._part(F.col("uid"))).distinct().collect()]  # at most the number of parts
        return self._live(known, F.col("bucket").isin(touched)).join(uids, "uid").select(F.col("segment").alias("of"), "doc", "dl", "bucket")

    def _live(self, segments: list[str], where: Column | None = None, all_segments: list[str] | None = None) -> DataFrame:
        docs, gone = self._read("docs", segments), self._read("gone", all_segments or segments).select(F.col("of").alias("segment"), "doc", "bucket")
        if where is not None:
            docs, gone = docs.where(where), gone.where(where)
        return docs.join(gone, ["segment", "doc", "bucket"], "left_anti")

    def _lay(self, rows: DataFrame, key: str, part: str, path: str) -> None:
        """Writes rows by the part of a key, in its order; a slice of a part is one file."""
        at = F.pmod(F.xxhash64(key), F.lit(self.parts * SLICES)).cast("int")
        laid = rows.withColumn("slice", at).repartition("slice").withColumn(part, F.col("slice") % self.parts)
        laid.sortWithinPartitions(part, key).drop("slice").write.mode("overwrite").partitionBy(part).parquet(path)

    def _write(self, name: str, docs: DataFrame, replaced: DataFrame | None) -> None:
        """A segment of documents (uid, dl, counts), with marks for what it replaces."""
        at = f"{self.path}/segments/{name}"
        put = lambda df, table: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/{table}")
        have = lambda table: self.spark.read.schema(TABLES[table]).parquet(f"{at}/{table}")
        put(docs.select("uid", "dl", "counts").sortWithinPartitions("dl", "uid").withColumn("doc", F.monotonically_increasing_id()), "counts")
        placed = have("counts")
        self._lay(placed.select("uid", "dl", "doc"), "uid", "bucket", f"{at}/docs")
        workers_import(self.spark)
        batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(batch)
        self.spark.conf.set(batch, min(int(before), DOCS) if int(before) > 0 else DOCS)
        try:
            put(placed.select("doc", "dl", "counts").mapInArrow(_in_blocks(self.bits), TABLES["blocks"]), "blocks")
        finally:
            self.spark.conf.set(batch, before)
        words = have("blocks").select("term").distinct().select("term", F.explode(pieces(F.col("term"))).alias("piece"))
        self._lay(words, "piece", "part", f"{at}/words")
        none = self.spark.createDataFrame([], "of string, doc long, dl int, bucket int")
        (replaced if replaced is not None else none).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/gone")
        placed.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).write.mode("overwrite").parquet(f"{at}/size")  # one row

    def _unmarked(self, docs: DataFrame, gone: DataFrame) -> DataFrame:
        """Documents without those that are marked; the marks go to the tasks as a bit a document of the blocks that have some."""
        at = F.shiftright("doc", 6)
        bits = gone.groupBy(F.col("of").alias("segment"), at.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(doc & 63 as int))")).alias("bits"))
        live = F.col("bits").isNull() | (F.expr("shiftright(bits, cast(doc & 63 as int)) & 1L") == 0)
        return docs.withColumn("word", at).join(F.broadcast(bits), ["segment", "word"], "left").where(live).drop("word", "bits")

    def merge(self, most: int = MOST_SEGMENTS) -> None:
        """With more than ``most`` segments, the smallest become one, until half as many are left."""
        known = self.segments()
        if len(known) <= most:
            return
        sizes = {r["segment"]: r["n"] for r in self._read("size", known).select("segment", "n").collect()}
        chosen = set(sorted(known, key=lambda s: sizes[s])[: len(known) - max(1, most // 2) + 1])
        old = [s for s in known if s in chosen]
        gone, outside = self._read("gone", known), ~F.col("of").isin(list(chosen))
        docs = self._unmarked(self._read("counts", old), gone.where(~outside))
        marks = self._read("gone", old).where(outside).select("of", "doc", "dl", "bucket")  # about segments that stay
        name = f"m{uuid.uuid4().hex}"
        self._write(name, docs, marks)
        self._name([s for s in known if s not in chosen] + [name])

    def drop(self) -> None:
        """Deletes the index."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    # ---- reading

    def near(self, words: Sequence[str], edits: int = MOST_EDITS) -> dict[str, float]:
        """Terms of the index within ``edits`` of the words: 1 less the distance over the shorter length, summed over the words."""
        known, asked = self.segments(), sorted(set(words))
        if not known or not asked:
            return {}
        some = [(w, *p) for w in asked for p in _asked_pieces(w)]  # a bounded number for each word
        mine = self.spark.createDataFrame(some, "word string, n int, j int, said string").select("word", F.xxhash64("n", "j", "said").alias("piece")).withColumn("part", self._part(F.col("piece")))
        keys = mine.select("piece", "part").distinct().collect()
        rows = self._read("words", known).where(F.col("part").isin(sorted({k["part"] for k in keys})) & F.col("piece").isin(sorted({k["piece"] for k in keys})))
        dist, least = F.levenshtein("word", "term"), F.least(F.length("word"), F.length("term"))
        met = rows.select("piece", "term").join(F.broadcast(mine.drop("part")), "piece").select("word", "term").where((F.levenshtein("word", "term", edits) >= 0)).distinct()
        close = met.select("term", (1 - dist / least).alias("w")).where("w > 0").groupBy("term").agg(F.sum("w").alias("w"))
        return {r["term"]: r["w"] for r in close.collect()}

    def _weigh(self, weights: dict[str, float], average: float, tf: str, dl: str) -> Column:
        of = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("term"))
        return of * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.lit(average)))

    def search(self, terms: dict[str, float] | Sequence[str], least: float | None = None, top: int = TOP, digits: int = 6) -> Found:
        """The best documents by BM25 of the terms times their weights (1 if not given)."""
        asked = dict(terms) if isinstance(terms, dict) else dict.fromkeys(terms, 1.0)
        known = self.segments()
        if not known or not asked:
            return Found([], 0, 0)
        gone = self._read("gone", known).where(F.col("of").isin(known)).select(F.col("of").alias("segment"), "doc", F.col("dl").alias("less"))
        sums = self._read("size", known).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).first()
        lost = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("less"), F.lit(0)).alias("tokens")).first()
        size = {k: (sums[k] or 0) - lost[k] for k in ("n", "tokens")}
        blocks, dead = self._read("blocks", known).where(F.col("term").isin(sorted(asked))), gone.select("segment", "doc")
        heads = materialize(blocks.select("segment", "block", "term", "n", "most_tf", "least_dl"), "index-heads")
        df = heads.groupBy("term").agg(F.sum("n").alias("n"))
        if lost["n"]:
            touched = dead.select("segment", F.shiftright("doc", self.bits).alias("block")).distinct()
            marked = blocks.join(touched, ["segment", "block"], "left_semi").select("segment", "term", F.explode("docs.doc").alias("doc")).join(dead, ["segment", "doc"], "left_semi")
            df = df.unionByName(marked.groupBy("term").agg((-F.count("*")).alias("n"))).groupBy("term").agg(F.sum("n").alias("n"))
        df = df.collect()  # a row a term
        weights = {r["term"]: asked[r["term"]] * math.log(1 + (size["n"] - r["n"] + 0.5) / (r["n"] + 0.5)) for r in df if r["n"] > 0}
        if not weights:
            release(heads)
            return Found([], 0, 0)
        average = (size["tokens"] or 0) / size["n"] or 1.0
        bounds = materialize(heads.where(F.col("term").isin(list(weights))).groupBy("segment", "block").agg(F.sum(self._weigh(weights, average, "most_tf", "least_dl")).alias("bound"), F.count("*").alias("n")), "index-bounds")
        total, read, best, floor = bounds.agg(F.sum("n")).first()[0], 0, [], -math.inf if least is None else least
        names, taken, slack = self._read("counts", known).select("segment", "doc", "uid"), math.inf, 10.0**-digits

        def score(some: DataFrame) -> list[tuple[str, float]]:
            rows = blocks.where(F.col("term").isin(list(weights))).join(some.select("segment", "block"), ["segment", "block"], "left_semi").select("segment", "term", F.explode("docs").alias("d")).select("segment", "term", "d.*")
            each = (rows.join(dead, ["segment", "doc"], "left_anti") if lost["n"] else rows).groupBy("segment", "doc").agg(F.round(F.sum(self._weigh(weights, average, "tf", "dl")), digits).alias("score"))
            each = each.where(F.col("score") > least) if least is not None else each
            ranked = each.where(F.col("score") >= floor) if math.isfinite(floor) else each
            return [(r["uid"], r["score"]) for r in ranked.join(names, ["segment", "doc"]).orderBy(F.desc("score"), "uid").limit(top).collect()]

        for many in (*ROUNDS, None):
            rest = bounds.where((F.col("bound") >= floor - slack) & (F.col("bound") < taken)) if math.isfinite(taken) or math.isfinite(floor) else bounds
            if many is None:
                some, n = rest, rest.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            else:
                heavy = rest.orderBy(F.desc("bound")).limit(many).agg(F.min("bound").alias("b"), F.count("*").alias("c")).first()
                if not heavy["c"]:
                    break
                some = rest.where(F.col("bound") >= heavy["b"])
                n, taken = some.agg(F.sum("n")).first()[0], heavy["b"]
            if not n:
                break
            read += n
            best = sorted(best + score(some), key=lambda x: (-x[1], x[0]))[:top]
            floor = max(floor, best[-1][1]) if len(best) == top else floor
        release(heads)
        release(bounds)
        return Found(best, total, read)


def index_stream(stream: DataFrame, index: Index, checkpoint: str, most: int = MOST_SEGMENTS) -> StreamingQuery:
    """Keeps an index current with a stream of node rows: a segment a batch, merged when they are many."""

    def apply(batch: DataFrame, epoch: int) -> None:
        own = Index(batch.sparkSession, index.path, index.fields, index.parts, index.bits)
        own.upsert(batch, name=f"batch-{epoch}")
        own.merge(most)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

