"""Spelling variants: words one inserted, deleted or replaced code point apart, through pairs of trie nodes.

Words are kept in a trie, and reversed ones in another. A node of the first is a
prefix, one of the second a suffix, and each has an integer. A word's skipped pair
at i is (node before i, node after i), its split pair at i is (node before i, node
from i on). Two words differ in one replaced code point exactly where a skipped
pair of one is a skipped pair of the other, and by one inserted one exactly where
a skipped pair of the longer is a split pair of the shorter, so equality of two
integers finds all neighbours and nothing else, without comparing texts. Of a run
of equal code points only the first counts as left out, so a pair of words meets
in one place alone; a place holds a word for each letter of the alphabet at most,
so no key is hot.

Nodes are numbered along sorted words: a word shares the nodes of its common
prefix with the word before it and opens new ones after that, so the work is
linear in the letters even where words are very long. Words are dealt to sorted
buckets by split words (a bounded sample settles where they are, and with it only
how even the buckets are); a prefix that occurs on both sides of a split word is a
prefix of that split word, so those few nodes have numbers known to all tasks, and
all others belong to one bucket.

Defined cases: a null text has no runs; a null id counts as the empty text before
the colon; repeated rows count again; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, UPPER, materialize, release
from lexloom.session import workers_import

LETTERS = "A-Za-z\\u00C0-\\u00FF"
SLIPS, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5
#: Words in a bucket, most buckets, sampled words for each split, and code points of a split word.
BUCKET, MOST_BUCKETS, SAMPLED, SPLIT_LENGTH = 5_000, 2_000, 50, 64
SHIFT = 40


def counted(docs: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: lower-cased runs of letters of all texts, with the slips that the ids decide.

    Shorter runs can't give words of the least length, so they never leave the text.
    """
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    runs = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("head"), F.explode(found).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("head", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % SLIPS == 0, slipped).otherwise(F.col("run")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.length("word") >= least_length))


def common_prefix(a: str, b: str) -> int:
    if b.startswith(a):
        return len(a)
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


class Trie:
    """Numbers of the nodes along one word after the other, which come in order, bucket by bucket."""

    def __init__(self, splits: list[str]):
        self.splits = splits
        self.shared = {p: k for k, p in enumerate(sorted({s[:d] for s in splits for d in range(len(s) + 1)} | {""}))}
        self.bucket = -1

    def path(self, bucket: int, word: str) -> list[int]:
        """The node of each prefix, the empty one first."""
        if bucket != self.bucket:
            self.bucket, self.next, self.last, self.nodes = bucket, bucket + 1 << SHIFT, "", []
        around = self.splits[max(0, bucket - 1) : bucket + 1]
        known = max((common_prefix(s, word) for s in around), default=0)
        kept = common_prefix(self.last, word) if self.nodes else -1
        nodes = [self.shared[word[:d]] for d in range(known + 1)] + self.nodes[known + 1 : kept + 1]
        opened = len(word) + 1 - len(nodes)
        nodes += range(self.next, self.next + opened)
        self.next += opened
        self.last, self.nodes = word, nodes
        return nodes


def split_words(words: DataFrame, key: str, rows: int) -> list[str]:
    """Where the sorted words are cut, from a sample of bounded size."""
    buckets = min(MOST_BUCKETS, rows // BUCKET + 1)
    if buckets == 1:
        return []
    wanted = SAMPLED * buckets
    few = words.select(F.substring(key, 1, SPLIT_LENGTH).alias("s"), F.xxhash64(key).alias("h")).where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, wanted / rows)))
    found = sorted(r["s"] for r in few.select("s").limit(2 * wanted).collect())
    return sorted({found[k * len(found) // buckets] for k in range(1, buckets)}) if found else []


def numbered(words: DataFrame, reverse: bool) -> DataFrame:
    """words (word, n) -> word, n, nodes; forward also rank (orders words) and fresh (the code point differs from the one before)."""
    spark, rows = words.sparkSession, words.count()
    workers_import(spark)
    keyed = words.select("word", "n", (F.reverse("word") if reverse else F.col("word")).alias("key"))
    splits = split_words(keyed, "key", rows)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bisect.bisect_right(splits, k) for k in b.column(2).to_pylist()], pa.int32())], ["word", "n", "key", "bucket"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, bucket, place = Trie(splits), -1, 0
        for b in batches:
            nodes, ranks, fresh = [], [], []
            for at, key in zip(b.column(3).to_pylist(), b.column(2).to_pylist(), strict=True):
                if at != bucket:
                    bucket, place = at, 0
                path = trie.path(at, key)
                nodes.append(path[::-1] if reverse else path)
                if not reverse:
                    ranks.append((at << SHIFT) + place)
                    fresh.append([True, *(x != y for x, y in zip(key, key[1:], strict=False))])
                place += 1
            columns, names = [b.column(0), b.column(1), pa.array(nodes, pa.list_(pa.int64()))], ["word", "n", "nodes"]
            if not reverse:
                columns, names = [*columns, pa.array(ranks, pa.int64()), pa.array(fresh, pa.list_(pa.bool_()))], [*names, "rank", "fresh"]
            yield pa.RecordBatch.from_arrays(columns, names)

    placed = keyed.mapInArrow(dealt, "word string, n long, key string, bucket int").repartition("bucket").sortWithinPartitions("bucket", "key")
    return placed.mapInArrow(number, "word string, n long, nodes array<long>" + ("" if reverse else ", rank long, fresh array<boolean>"))


def neighbours(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """rank, n_near, best (n, -rank of the near word of largest n, least in order)."""
    both = forward.select("word", "rank", "n", "fresh", F.col("nodes").alias("head")).join(backward.select("word", F.col("nodes").alias("tail")), "word")
    last = F.size("fresh")

    def pair(i, rest, skipped, fresh):
        return F.struct(F.get("head", i).alias("p"), F.get("tail", rest).alias("s"), skipped.alias("skipped"), fresh.alias("fresh"))

    skips = F.transform(F.sequence(F.lit(0), last - 1), lambda i: pair(i, i + 1, F.lit(True), F.get("fresh", i)))
    splits = F.transform(F.sequence(F.lit(0), last), lambda i: pair(i, i, F.lit(False), F.lit(False)))
    rows = both.select("rank", "n", F.explode(F.concat(skips, splits)).alias("k")).select("k.*", "rank", "n")
    met = rows.groupBy("p", "s").agg(F.collect_list(F.struct("rank", "n", "skipped", "fresh")).alias("m")).where(F.size("m") > 1)  # a word for each letter, and one split

    def near(x, y):
        return (x["skipped"] & y["skipped"] & (x["rank"] != y["rank"])) | (x["fresh"] & ~y["skipped"]) | (~x["skipped"] & y["fresh"])

    each = met.select(F.explode(F.transform("m", lambda x: F.struct(x["rank"].alias("rank"), F.transform(F.filter("m", lambda y: near(x, y)), lambda y: F.struct(y["n"].alias("n"), (-y["rank"]).alias("r"))).alias("near")))).alias("e")).select("e.*")
    return each.where(F.size("near") > 0).groupBy("rank").agg(F.sum(F.size("near")).alias("n_near"), F.max(F.array_max("near")).alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """rank, root: forms followed to the last by doubling; a form's count is ``TIMES`` its word's, so chains are short and never close."""
    current = materialize(forms.select("rank", F.col("form").alias("root")), "spelling-roots")
    while True:
        u, v = current.alias("u"), current.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        after = materialize(u.join(v, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        release(current)
        if after.where("moved").isEmpty():
            return after.drop("moved")
        current = _kept(after)


def _kept(df: DataFrame) -> DataFrame:
    out = df.drop("moved")
    out._lexloom_path = df._lexloom_path
    return out


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word."""
    words = materialize(counted(docs, least_length, least), "spelling-words")
    forward = materialize(numbered(words, reverse=False), "spelling-forward")
    near = materialize(neighbours(forward, numbered(words, reverse=True)), "spelling-near")
    release(words)
    joined = forward.select("rank", "word", "n").join(near, "rank", "left")
    formed = materialize(joined.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best.n") >= times * F.col("n"), -F.col("best.r")).alias("form")), "spelling-forms")
    release(forward)
    release(near)
    roots = followed(formed.where("form is not null").select("rank", "form"))
    named = formed.where("form is not null").select("rank", "form").join(roots, "rank")
    said = formed.select("rank", "word", "n")
    named = named.join(said.select(F.col("rank").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n")), "form")
    named = named.join(said.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "form_word", "form_n", "root_word")
    return formed.drop("form").join(named, "rank", "left").select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """The same rows in DuckDB; the CRC is taken bit by bit over each byte, as DuckDB has none."""
    return f"""
with recursive runs as materialized (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') as run from documents),
keyed as (select run, count(*) as k, coalesce(doc_id::varchar, '') || ':' || run as said from runs where length(run) >= {LEAST_LENGTH} group by run, doc_id),
coded as (
  select run, k, list_reduce(
      flatten(list_transform(range(0, strlen(said)), lambda i: list_prepend(('0x' || substr(hex(encode(said)), 2 * i + 1, 2))::bigint, [-1, -1, -1, -1, -1, -1, -1, -1]::bigint[]))),
      lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, (c & 1) * 3988292384) end, 4294967295::bigint) as c from keyed),
hashed as (select run, k, xor(c, 4294967295::bigint) as h from coded),
words as materialized (
  select case when h % {SLIPS} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(k)::bigint as n
  from hashed group by 1 having length(word) >= {LEAST_LENGTH} and n >= {LEAST_COUNT}),
skips as materialized (select word, n, left(word, i::int) as p, substr(word, i::int + 2) as s from words, unnest(range(0, length(word))) as t(i)),
splits as (select word, n, left(word, i::int) as p, substr(word, i::int + 1) as s from words, unnest(range(0, length(word) + 1)) as t(i)),
pairs as materialized (
  select a.word as a, b.word as b, b.n as bn from skips a join skips b on a.p = b.p and a.s = b.s and a.word <> b.word
  union select a.word, b.word, b.n from skips a join splits b on a.p = b.p and a.s = b.s
  union select b.word, a.word, a.n from skips a join splits b on a.p = b.p and a.s = b.s),
best as (select a, count(*) as n_near, arg_min(b, (-bn, b)) as b, max(bn) as bn from pairs group by a),
forms as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when bn >= {TIMES} * w.n then b end as form, case when bn >= {TIMES} * w.n then bn end as form_n
  from words w left join best on best.a = w.word),
walk as (select word, word as at from forms union all select walk.word, forms.form from walk join forms on forms.word = walk.at where forms.form is not null),
roots as (select walk.word, walk.at as root from walk join forms on forms.word = walk.at where forms.form is null)
select word, form, root, n, n_near, form_n from forms join roots using (word)"""
