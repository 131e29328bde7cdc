"""Phrase collocation mining by direct-address tiling, per language.

Words that can be part of a phrase (as frequent as a phrase has to be) get ids by
falling frequency over all languages together, so that the cells of a table
(left id, right id) that are hit often lie in few square tiles. Each task turns
texts into ids and counts neighbours tile by tile: a tile that is hit often is a
dense array filled by ``bincount``, the others together are a sorted list of
coordinates (COO). Spark adds the cells of all tasks. Frequent pairs are then
ranked and numbered in the same way, and the same tiles count (pair, word), the
phrases of three words whose both pairs are frequent.

Tasks hold the ``WORDS`` hottest words and ``PAIRS`` hottest pairs, a bounded size.
Phrases with others are no less exact: tasks add them up by their text, and Spark
sums those texts; only their counts of parts come by a join, on keys that are rare
by construction, since the hottest ones are held. Ranks, of words, pairs and the
report, are places in a range-partitioned order, shifted by what the partitions
before hold, so no task orders the rows of a language.

Scores are whole numbers of 38 digits; a phrase may occur 10^16 times.

Defined cases: a null text is an empty one, a null language is ``und``; repeated
rows count again; languages without phrases and empty tables give no rows.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, UPPER, materialize, release, small_batches

LEAST, SHARE, TOP = 10, 50, 2000
#: Hottest words and pairs that tasks hold.
WORDS, PAIRS = 1 << 19, 1 << 21
#: Ids on a tile's side, dense tiles of a task, hits of one buffer that make a tile dense, ids in a buffer.
SIDE, DENSE, CROWDED, BUFFER = 512, 32, 1 << 15, 1 << 20
CUTS = ".,;:!?\n\x0b\x0c\r"
PLAIN = bytes(10 if chr(b) in CUTS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
COLD, BREAK, BLANK = -1, -2, -3


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of all words."""
    words = F.split(F.translate("text", UPPER, LOWER), "[.,;:!?\\x0A-\\x0D\\x20\\x09]+")
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(words).alias("word")).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("f"))


def in_order(df: DataFrame, order: list[Column], name: str, by: list[str]) -> DataFrame:
    """df and ``place``, its number from 0 in the given order (which starts with ``by``) among the rows of equal ``by``."""
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()), name)
    part = F.shiftright("_row", 33)
    held = rows.groupBy(part.alias("_part"), *by).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("_part", *by, "_first", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each partition and value of by
    out = rows.withColumn("_part", part).join(held, ["_part", *by]).withColumn("place", F.col("_before") + F.col("_row") - F.col("_first")).drop("_part", "_row", "_first", "_before")
    out._lexloom_path = rows._lexloom_path
    return out


@dataclass
class Lexicon:
    """The hottest words by rank, as columns; what tasks look up is built where it is used. ``whole``: no other word is frequent."""

    langs: pa.ChunkedArray
    spelt: pa.ChunkedArray
    f: np.ndarray
    whole: bool

    @classmethod
    def of(cls, rows: pa.Table, whole: bool) -> Lexicon:
        rows = rows.sort_by("place")
        return cls(rows.column("lang").dictionary_encode(), rows.column("word"), rows.column("f").to_numpy(), whole)

    @functools.cached_property
    def ids(self) -> dict[str, dict[bytes, int]]:
        found: dict[str, dict[bytes, int]] = {}
        for k, (lang, word) in enumerate(zip(self.langs.to_pylist(), self.spelt.cast(pa.binary()).to_pylist(), strict=True)):
            found.setdefault(lang, {b"\n": BREAK, b"": BLANK})[word] = k
        return found

    def word(self, k: int) -> tuple[str, str]:
        return self.langs[k].as_py(), self.spelt[k].as_py()

    def count(self, lang: str, word: str) -> int | None:
        k = self.ids.get(lang, {}).get(word.encode(), COLD)
        return int(self.f[k]) if k >= 0 else None


@dataclass
class Pairs:
    """The hottest pairs of held words by rank: their codes and counts, and where each code is. ``whole``: no other such pair is frequent."""

    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    whole: bool = True

    @functools.cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.codes)

    @functools.cached_property
    def ordered(self) -> np.ndarray:
        return self.codes[self.order]

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The rank of each code, or -1."""
        if not len(self.codes):
            return np.full(len(codes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.ordered, codes), len(self.codes) - 1)
        return np.where(self.ordered[at] == codes, self.order[at], -1)


class Tiles:
    """Counts of (left, right) ids: dense tiles, the rest as sorted coordinates."""

    def __init__(self, side: int = SIDE, dense: int = DENSE, crowded: int = CROWDED):
        self.side, self.most, self.crowded = side, dense, crowded
        self.dense: dict[int, np.ndarray] = {}

    def add(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes what falls on dense tiles; the sorted codes and counts of the rest come back."""
        side = self.side
        tile = (left // side << 32) + right // side
        order = np.argsort(tile, kind="stable")
        left, right, tile = left[order], right[order], tile[order]
        starts = np.flatnonzero(np.diff(tile, prepend=-1))
        ends = np.append(starts[1:], len(tile))
        sparse = np.ones(len(tile), bool)
        chosen = (ends - starts >= self.crowded) | np.isin(tile[starts], list(self.dense))
        for a, b in zip(starts[chosen], ends[chosen], strict=True):
            at = int(tile[a])
            if at not in self.dense and len(self.dense) >= self.most:
                continue
            cells = left[a:b] % side * side + right[a:b] % side
            self.dense[at] = self.dense.get(at, 0) + np.bincount(cells, minlength=side * side)
            sparse[a:b] = False
        return np.unique((left[sparse] << 32) + right[sparse], return_counts=True)

    def flush(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for tile, cells in self.dense.items():
            at = np.flatnonzero(cells)
            yield ((tile >> 32) * self.side + at // self.side << 32) + (tile & 0xFFFFFFFF) * self.side + at % self.side, cells[at]
        self.dense = {}


def _batch(codes, counts) -> pa.RecordBatch:
    none = pa.nulls(len(codes), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), none, none, pa.array(counts, pa.int64())], ["code", "lang", "phrase", "n"])


def neighbour_counts(docs: DataFrame, lexicon: Lexicon, pairs: Pairs | None = None) -> DataFrame:
    """code or (lang, phrase), n: pairs of words or, with ``pairs``, of a pair and a word, seen at least LEAST times."""
    spark = docs.sparkSession
    held, whole = spark.sparkContext.broadcast((lexicon, pairs)), lexicon.whole and (pairs is None or pairs.whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, pairs = held.value
        tiles, other, size = Tiles(), {b"\n": BREAK, b"": BLANK}, 2 if pairs is None else 3
        ids: list[np.ndarray] = []
        tokens: list[bytes] = []
        langs: list[str] = []
        size_now = 0

        def empty() -> Iterator[pa.RecordBatch]:
            at = np.concatenate(ids)
            left, right = at[:-1], at[1:]
            known, may = (left >= 0) & (right >= 0), np.zeros(len(left), bool)
            if not lexicon.whole:
                may = ((left == COLD) | (right == COLD)) & (left != BREAK) & (right != BREAK)
            if pairs is not None:
                found = np.full(len(left), -1, np.int64)
                found[known] = pairs.find((left[known] << 32) + right[known])
                if not pairs.whole:
                    may |= known & (found < 0)
                known = found >= 0
                may = (may | known)[:-1] & (may | known)[1:] & ~(known[:-1] & known[1:])
                known = known[:-1] & known[1:]
                left, right = found[:-1], at[2:]
            yield _batch(*tiles.add(left[known], right[known]))
            if not whole:
                lang = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
                rest = Counter((lang[k], b" ".join(tokens[k : k + size])) for k in np.flatnonzero(may))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rest), pa.int64()), pa.array([langs[k] for k, _ in rest], pa.string()), pa.array([p.decode("utf-8", "replace") for _, p in rest], pa.string()), pa.array(list(rest.values()), pa.int64())], ["code", "lang", "phrase", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "replace").translate(PLAIN).replace(b"\n", b" \n ").split(b" ")
                own = np.fromiter(map(lexicon.ids.get(lang, other).get, words, repeat(COLD)), np.int64, len(words))
                kept = own != BLANK
                ids.append(np.append(own[kept], BREAK))
                if not whole:
                    langs.append(lang)
                    tokens += [w for w, k in zip(words, kept, strict=True) if k] + [b"\n"]
                size_now += len(ids[-1])
                if size_now >= BUFFER:
                    yield from empty()
                    ids, tokens, langs, size_now = [], [], [], 0
        if ids:
            yield from empty()
        for codes, counts in tiles.flush():
            yield _batch(codes, counts)

    small_batches(spark, 500)
    found = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, "code long, lang string, phrase string, n long")
    keys = ["code"] if whole else ["code", "lang", "phrase"]
    out = materialize(found.groupBy(*keys).agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST), "phrases-counted")
    held.destroy()
    if whole:
        none = F.lit(None).cast("string")
        path, out = out._lexloom_path, out.select("code", none.alias("lang"), none.alias("phrase"), "n")
        out._lexloom_path = path
    return out


def named(found: DataFrame, lexicon: Lexicon, pairs: Pairs, three: bool) -> DataFrame:
    """lang, phrase, a, cuts (left, right, l, r): counts of parts that tasks don't hold stay null."""
    held = found.sparkSession.sparkContext.broadcast((lexicon, pairs))
    cuts = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string()), ("l", pa.int64()), ("r", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, pairs = held.value

        def count(lang: str, part: list[str]) -> int | None:
            if len(part) == 1:
                return lexicon.count(lang, part[0])
            a, b = (lexicon.ids.get(lang, {}).get(w.encode(), COLD) for w in part)
            at = pairs.find(np.array([(a << 32) + b]))[0] if a >= 0 and b >= 0 else -1
            return int(pairs.counts[at]) if at >= 0 else None

        for batch in batches:
            out: list[list] = [[], [], []]
            for code, lang, phrase in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if code is None:
                    words = phrase.split(" ")
                else:
                    first, last = code >> 32, code & 0xFFFFFFFF
                    own = [*divmod(int(pairs.codes[first]), 1 << 32), last] if three else [first, last]
                    lang, words = lexicon.word(last)[0], [lexicon.word(k)[1] for k in own]
                parts = [(words[:k], words[k:]) for k in range(1, len(words))]
                for column, value in zip(out, (lang, " ".join(words), [{"left": " ".join(x), "right": " ".join(y), "l": count(lang, x), "r": count(lang, y)} for x, y in parts]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), batch.column(3), pa.array(out[2], cuts)], ["lang", "phrase", "a", "cuts"])

    named = found.select("code", "lang", "phrase", "n").mapInArrow(run, "lang string, phrase string, a long, cuts array<struct<left:string,right:string,l:long,r:long>>")
    out = materialize(named, "phrases-named")
    held.destroy()
    return out


def scored(candidates: DataFrame, parts: DataFrame, whole: bool) -> DataFrame:
    """lang, phrase, a, l, r, score of the lowest cut; ``parts`` (lang, part, f) has the counts that no task held."""
    rows = candidates.select("lang", "phrase", "a", F.posexplode("cuts").alias("k", "c")).select("lang", "phrase", "a", "k", "c.*")
    if not whole:
        sides = F.array(F.when(F.col("l").isNull(), F.struct(F.lit("l").alias("side"), F.col("left").alias("part"))), F.when(F.col("r").isNull(), F.struct(F.lit("r").alias("side"), F.col("right").alias("part"))))
        gaps = rows.select("lang", "phrase", "k", F.explode(F.array_compact(sides)).alias("g")).select("lang", "phrase", "k", "g.*").join(parts, ["lang", "part"])
        filled = gaps.groupBy("lang", "phrase", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("_l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("_r"))
        rows = rows.join(filled, ["lang", "phrase", "k"], "left").withColumns({"l": F.coalesce("l", "_l"), "r": F.coalesce("r", "_r")})
    score = F.expr("(cast(1000000 as decimal(38,0)) * a * a) div (cast(l as decimal(38,0)) * r)")
    best = rows.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def mine(docs: DataFrame, top: int = TOP, words_held: int = WORDS, pairs_held: int = PAIRS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    counts = materialize(word_counts(docs), "phrases-words")
    totals = materialize(counts.groupBy("lang").agg(F.sum("f").alias("n")), "phrases-totals")
    ranked = in_order(counts.where(F.col("f") >= LEAST), [F.desc("f"), F.asc("lang"), F.asc("word")], "phrases-ranked", [])
    hot = ranked.where(F.col("place") < words_held).select("place", "lang", "word", "f").toArrow()  # at most words_held rows
    cold = ranked.where(F.col("place") >= words_held).select("lang", F.col("word").alias("part"), "f")
    lexicon = Lexicon.of(hot, cold.isEmpty())
    release(counts)

    found = neighbour_counts(docs, lexicon)
    ordered = in_order(found.where("code is not null").select("code", "n"), [F.desc("n"), F.asc("code")], "phrases-pairs", [])
    held = ordered.where(F.col("place") < pairs_held).select("place", "code", "n").toArrow().sort_by("place")  # at most pairs_held rows
    pairs = Pairs(held.column("code").to_numpy(), held.column("n").to_numpy(), ordered.where(F.col("place") >= pairs_held).isEmpty())
    release(ordered)
    twos = named(found, lexicon, pairs, three=False)
    release(found)
    found = neighbour_counts(docs, lexicon, pairs)
    threes = named(found, lexicon, pairs, three=True)
    release(found)

    parts = cold.unionByName(twos.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    best = scored(twos.unionByName(threes), parts, lexicon.whole and pairs.whole)
    inner = threes.select("lang", "a", F.explode(F.array(F.col("cuts")[0]["right"], F.col("cuts")[1]["left"])).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < SHARE * F.col("a"))).drop("longer")
    placed = in_order(left, [F.asc("lang"), F.desc("score"), F.desc("a"), F.asc("phrase")], "phrases-placed", ["lang"])
    for table in (ranked, twos, threes):
        release(table)
    return placed.where(F.col("place") < top).join(totals, "lang").select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(top: int = TOP) -> str:
    return f"""
with pieces as (
  select lang, row_number() over () as p, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') as ws
  from (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
tokens as (select lang, p, unnest(ws) as w, generate_subscripts(ws, 1) as i from pieces),
runs as (select lang, w, lead(w) over (partition by p order by i) as w2, lead(w, 2) over (partition by p order by i) as w3 from tokens),
grams as (select lang, w as phrase from runs union all select lang, w || ' ' || w2 from runs where w2 is not null union all select lang, w || ' ' || w2 || ' ' || w3 from runs where w3 is not null),
f as materialized (select lang, phrase, len(string_split(phrase, ' ')) as k, count(*) as a from grams group by lang, phrase),
totals as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
candidates as materialized (select *, string_split(phrase, ' ') as ws from f where k > 1 and a >= {LEAST}),
cuts as (select lang, phrase, a, k, c, array_to_string(ws[1:c], ' ') as x, array_to_string(ws[c + 1:], ' ') as y from candidates, (values (1), (2)) as t(c) where c < k),
scores as (select cuts.lang, cuts.phrase, cuts.a, c, x.a as l, y.a as r, (1000000::hugeint * cuts.a * cuts.a) // (x.a::hugeint * y.a) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = cuts.x join f y on y.lang = cuts.lang and y.phrase = cuts.y),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, c) = 1),
longer as (select lang, phrase, max(a) as b from (select lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase from candidates where k = 3) group by lang, phrase),
left_over as (select best.* from best left join longer using (lang, phrase) where b is null or 100 * b < {SHARE} * a)
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score from left_over join totals using (lang)) where rank <= {top}"""
