"""Best-fit packing by minimum bin slack: documents as token ids into sequences of fixed length.

Every document is encoded, gets an end id, and is cut into pieces only where it
is longer than a sequence. What decides a packing is how many pieces there are of
each length: at most ``capacity`` counts, whatever the corpus holds. Over these
counts the driver fills bin after bin: the longest length left, and with it the
combination of available lengths that leaves the least slack, found by subset-sum
dynamic programming on a bitset (one integer, shifted by each length). The
combination is removed and, as what remains can fill no bin better, removed again
as often as the counts allow. So a plan is a short list of (combination, times),
and the sequence of a piece follows from its length and its number among the
pieces of that length, by arithmetic. These numbers are counted while a task
writes its pieces and shifted by what other tasks hold: no task orders the pieces
of a length, and nothing but counts reaches the driver.

Defined cases: a null text is an empty one, whose only id is the end; repeated
rows and rows with null ids are documents of their own; very long texts are cut
after they were encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import materialize, small_batches
from lexloom.llm.op9_bpe import BLANKS, Codec, default_path

CAPACITY, END = 2048, 0
#: Chunks between blanks and words whose ids a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 600_000, 48
PIECE = "piece int, start long, length long, ids binary, task string, nth long"


def plain(text: str) -> str:
    """Composed, blanks alike, lower case letter by letter (so a final sigma is like any other)."""
    return BLANKS.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()


class Encoder(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit integers.

    The file's words never hold a blank or a line end, so a text's ids are those of
    its chunks between them, one after the other. Operator 9 finds the words of a
    chunk; the tokenizers library splits them.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.codec, self.model, self.words = Codec(path), Tokenizer.from_file(path).model, {}
        self.bytes = [k.to_bytes(4, "little") for k in range(1 + max(self.codec.names))]

    def of_word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            symbols = word if word.isascii() and word.isalpha() else "".join([self.codec.chars[b] for b in word.encode("utf-8", "replace")])
            found = b"".join([self.bytes[t.id] for t in self.model.tokenize(symbols)])
            if len(word) <= LONGEST and len(self.words) < REMEMBERED:
                self.words[word] = found
        return found

    def __missing__(self, chunk: str) -> bytes:
        if "<" in chunk:  # a special token may be in it
            ids = b"".join([self.bytes[k] for k in self.codec.encode(chunk)])
        else:
            low = chunk.lower() if chunk.isascii() else plain(chunk)
            if low.isascii() and low[:-1].isalpha() and low[-1] > " ":  # a word, or a word and a sign or digit
                ids = self.of_word(low) if low[-1].isalpha() else self.of_word(low[:-1]) + self.of_word(low[-1])
            else:
                ids = b"".join(map(self.of_word, self.codec.words.findall(low)))
        if len(chunk) <= LONGEST and len(self) < REMEMBERED:
            self[chunk] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each file and worker."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), and the piece's number ``nth`` among those of its length in its ``task``."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = encoder(path), uuid.uuid4().hex, Counter()
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows, piece, start, length, ids, nth = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                whole = own.ids(text.as_py()) + last
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[at : at + 4 * capacity]
                    n = len(part) // 4
                    for out, value in zip((rows, piece, start, length, ids, nth), (row, k, at // 4, n, part, seen[n]), strict=True):
                        out.append(value)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(rows), pa.string()), pa.array(nth, pa.int64())], ["doc_id", "piece", "start", "length", "ids", "task", "nth"])

    small_batches(docs.sparkSession, 500)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECE}")


def fullest(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """How many of each length (``order``: longest first) fill ``room`` best; shorter ones only where longer ones can't do."""
    reach, mask, steps = 1, (2 << room) - 1, []
    for length in order:
        left, lot = min(counts[length], room // length) if length <= room else 0, 1
        while left and not reach >> room & 1:
            lot = min(lot, left)
            after = reach | reach << length * lot & mask
            if after != reach:
                steps.append((length, lot, reach))
            reach, left, lot = after, left - lot, lot * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, Counter()
    for length, lot, before in reversed(steps):
        if not before >> at & 1:
            used[length] += lot
            at -= length * lot
    return dict(used)


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, times): bins filled one after the other, each around the longest length left."""
    left = {k: v for k, v in counts.items() if v > 0}
    order, plan = sorted(left, reverse=True), []
    while order:
        longest = order[0]
        left[longest] -= 1
        one = Counter(fullest(left, order, capacity - longest))
        left[longest] += 1
        one[longest] += 1
        times = min(left[length] // n for length, n in one.items())
        for length, n in one.items():
            left[length] -= n * times
        plan.append((dict(one), times))
        order = [length for length in order if left[length]]
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """For each combination and length: from which number of the length on it takes pieces, how many a bin, its first bin and their first place."""
    rows, taken, bins = [], Counter(), 0
    for one, times in plan:
        offset = 0
        for length in sorted(one, reverse=True):
            rows.append((length, taken[length], one[length], bins, offset))
            taken[length] += one[length] * times
            offset += one[length] * length
        bins += times
    return pd.DataFrame(sorted(rows), columns=["length", "first", "each", "bin", "offset"]).astype("int64")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: sequences are gapless from offset 0, in as few bins as found."""
    cut = materialize(pieces(docs, path, capacity, end), "packing-pieces")
    held = materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "packing-counts")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    at = places(minimum_slack(counts, capacity))
    shift = 1 << 50  # lengths and numbers in one ordered key
    keys, table = (at["length"] * shift + at["first"]).to_numpy(), at.to_numpy()

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        found = table[np.searchsorted(keys, length.to_numpy() * shift + number.to_numpy(), side="right") - 1]
        lot, k = np.divmod(number.to_numpy() - found[:, 1], found[:, 2])
        return pd.DataFrame({"sequence_id": found[:, 3] + lot, "offset": found[:, 4] + k * found[:, 0]})

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = held.select("task", "length", before.alias("before"))
    out = cut.join(first, ["task", "length"]).withColumn("_at", place("length", F.col("before") + F.col("nth")))
    return out.select("doc_id", "piece", "start", "length", "ids", "_at.sequence_id", "_at.offset")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The packing with the CRC of each piece's ids in their place."""
    return pack(docs, path).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
