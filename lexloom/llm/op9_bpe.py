"""BPE encoding and decoding with a tokenizer file of the ``tokenizers`` library.

A short word is held as contiguous arrays: the start boundary of every part,
its id, and the rank of merging it with its right neighbour. The smallest rank
is found by a scan, the boundary right of it is deleted, and the two ranks next
to the joined part are refreshed, until no neighbouring pair has a rank. Words
of more than SHORT parts keep the same order of merges in a heap over linked
parts, as repeated scans would be quadratic there.

The file's own steps are followed: special tokens are cut out of the raw text,
then NFC, runs of white space to one blank, lower case, the file's word pattern
(matches are the words, the rest is dropped) and bytes as printable characters.
The file has no decoder, so decoded text is the tokens joined by one blank.

Defined cases: a null text is an empty one; an empty or blank text has no ids
and decodes to the empty string; repeated rows stay; an empty table gives an
empty result. Files with other steps than these are refused.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import small_batches

SHORT = 64
BLANKS = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Distinct words a worker remembers.
REMEMBERED = 400_000


def printable_bytes() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next free one from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = itertools.count(256)
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [spec["pre_tokenizer"]["pretokenizers"], spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or [[x["type"] for x in kind] for kind in steps] != [["Split", "ByteLevel"], ["NFC", "Replace", "Lowercase"]] or spec["decoder"] or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path} has steps that this codec does not know")
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {i: s for s, i in (self.ids | self.special).items()}
        self.words = regex.compile(steps[0][0]["pattern"]["Regex"])
        self.chars = printable_bytes()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[self.ids[a], self.ids[b]] = (n, self.ids[a + b])
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            symbols = [self.chars[b] for b in word.encode("utf-8", "replace")]
            symbols[-1] += self.end
            parts = [self.ids[s] for s in symbols if s in self.ids]
            found = tuple(self._scan(parts) if len(parts) <= SHORT else self._queue(parts))
            if len(self.known) < REMEMBERED and len(word) <= 64:
                self.known[word] = found
        return found

    def _scan(self, ids: list[int]) -> list[int]:
        """Merge by scanning the array of adjacent ranks for its least element."""
        none = len(self.rank)
        rank = [self.rank.get(p, (none,))[0] for p in itertools.pairwise(ids)]
        while rank and (least := min(rank)) < none:
            at = rank.index(least)
            ids[at] = self.rank[ids[at], ids[at + 1]][1]
            del ids[at + 1], rank[at]
            if at < len(rank):
                rank[at] = self.rank.get((ids[at], ids[at + 1]), (none,))[0]
            if at:
                rank[at - 1] = self.rank.get((ids[at - 1], ids[at]), (none,))[0]
        return ids

    def _queue(self, ids: list[int]) -> list[int]:
        """The same merges for long words: a heap of (rank, place) over linked parts."""
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j] = self.rank[a, b][1], -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y < n and (r := self.rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (r[0], x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for piece in (self.cut.split(text) if self.cut else [text]) if text else ():
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                # a final sigma is no case of its own where characters are lowered one by one
                plain = BLANKS.sub(" ", unicodedata.normalize("NFC", piece)).replace("Σ", "σ").lower()
                out += itertools.chain.from_iterable(map(self.of_word, self.words.findall(plain)))
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


@functools.lru_cache(4)
def codec(path: str) -> Codec:
    """One codec for each file and worker."""
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids, decoded; ids are decoded again from the array."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    small_batches(docs.sparkSession, 500)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded text."""
    return encode_and_decode(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
