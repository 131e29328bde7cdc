"""Hidden Markov language model with exact sequence likelihoods.

Tokens are the words of a text, A-Z lower-cased, and one end. The HMM's states
emit symbols: the SYMBOLS most frequent training words each have their own, all
other words share CLASSES symbols by their last two bytes, and the end has one.
A word of a class is drawn from the class's add-one distribution over its
training words and one unseen word. So the probability of a text is that of its
symbols, summed over all state paths, times those of its words in their
classes: a proper model of any text.

* Word counts: partial counts leave each partition, one shuffle adds them up.
* Start: counts of neighbouring symbols over all training texts (a bounded
  matrix) are factored into states, which breaks the symmetry of the states.
* Baum-Welch: in every round each partition runs scaled forward and backward
  passes over its texts, emits its expected counts, and Spark adds them up; what
  reaches the driver is one row for each symbol.
* Scoring: the scaled forward recursion over every text, long ones included.
  Words beyond the HOT broadcast ones get their corpus counts by an equi-join;
  such words are rare by choice, so no join key is hot.

Defined cases: null texts are empty ones, an empty text is one end token; rows
without id are scored but not learned from; repeated rows count and are scored
each; without training rows every word is unseen; empty tables give empty results.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import byte_words, fold, materialize, release, small_batches

#: Bounds of what is broadcast: words with known counts, words with a symbol of their own.
HOT, SYMBOLS = 200_000, 32_768
CLASSES, STATES, ROUNDS = 256, 8, 3
#: Frequent symbols whose neighbours give the start, and passes over that matrix.
NEIGHBOURS, STEPS = 512, 120
#: Weight of the corpus distribution in each state's emissions, in tokens.
PRIOR = 10.0
#: Words or tokens that a task holds at once.
HELD_WORDS, HELD_TOKENS = 300_000, 500_000
END = ""


class Lexicon(NamedTuple):
    """What counting gives: corpus totals, and the hot words with their places."""

    total: int
    distinct: int
    ends: int
    place: dict[bytes, int]  # hot words, most frequent first
    count: np.ndarray  # of each hot word
    class_size: np.ndarray  # N_k + V_k + 1 of each class
    unigram: np.ndarray  # of each symbol


class Hmm(NamedTuple):
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # states x symbols


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def word_counts(texts: DataFrame) -> DataFrame:
    """(text) -> word, n; the end is the empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(byte_words(text))
                held[b""] += 1
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(counts: DataFrame) -> Lexicon:
    """Hot words are those above a count that at most HOT words reach."""
    words = counts.where(F.col("word") != END)
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("v"), F.min("n").alias("least")).collect()
    least, held = None, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        held += r["v"]
        if held > HOT:
            break
        least = r["least"]
    hot = words.where(F.col("n") >= (least if least is not None else 1 << 62)).select("word", "n").collect()
    hot = sorted(((r["word"].encode(), r["n"]) for r in hot), key=lambda x: (-x[1], x[0]))
    tail = F.substring(F.col("word").cast("binary"), -2, 2)
    by_class = {r["k"]: (r["n"], r["v"]) for r in words.groupBy((F.crc32(tail) % CLASSES).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    class_n, class_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for k, (n, v) in by_class.items():
        class_n[k], class_v[k] = n, v
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = int(class_n.sum()) + ends, int(class_v.sum()) + (ends > 0)
    for w, n in hot[:SYMBOLS]:
        class_n[word_class(w)] -= n
        class_v[word_class(w)] -= 1
    own = np.array([n for _, n in hot[:SYMBOLS]] + [0] * (SYMBOLS - len(hot[:SYMBOLS])), np.float64)
    seen = np.concatenate((own, class_n, [ends]))
    return Lexicon(total, distinct, ends, {w: i for i, (w, _) in enumerate(hot)}, np.array([n for _, n in hot], np.int64), (class_n + class_v + 1).astype(np.float64), (seen + 0.5) / (seen + 0.5).sum())


def encode(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """(row, doc_id, held_out, text) -> symbols as int32 bytes, sums over hot words, and the cold words with their counts."""
    sent = rows.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        words = list(lex.place)
        classes = np.fromiter(map(word_class, words), np.int64, len(words))
        log_count = np.log10(lex.count + 1.0)
        in_class = np.where(np.arange(len(words)) < SYMBOLS, 0.0, log_count - np.log10(lex.class_size[classes]))
        symbol = np.where(np.arange(len(words)) < SYMBOLS, np.arange(len(words)), SYMBOLS + classes)
        for batch in batches:
            ids, n_tokens, n_known, base, inner, cold, times = [], [], [], [], [], [], []
            for text in batch.column(3).to_pylist():
                found = byte_words(text)
                at = np.fromiter(map(lex.place.get, found, itertools.repeat(-1)), np.int64, len(found))
                known = at[at >= 0]
                seq = np.full(len(found) + 1, SYMBOLS + CLASSES, np.int32)
                if len(known) < len(found):
                    rest = np.flatnonzero(at < 0).tolist()
                    seq[rest] = [SYMBOLS + word_class(found[i]) for i in rest]
                    counted = Counter(found[i] for i in rest)  # a word comes once, however often the row has it
                    cold.append([w.decode() for w in counted])
                    times.append(list(counted.values()))
                else:
                    cold.append([])
                    times.append([])
                if len(known):
                    seq[:-1][at >= 0] = symbol[known]
                ids.append(seq.tobytes())
                n_tokens.append(len(seq))
                n_known.append(len(known) + (lex.ends > 0))
                base.append(float(log_count[known].sum() + np.log10(lex.ends + 1.0)) if len(words) else float(np.log10(lex.ends + 1.0)))
                inner.append(float(in_class[known].sum()) if len(words) else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(ids, pa.binary()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(inner, pa.float64()), pa.array(cold, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))], ["row", "doc_id", "held_out", "ids", "n_tokens", "n_known", "base", "inner", "cold", "times"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, ids binary, n_tokens long, n_known long, base double, inner double, cold array<string>, times array<bigint>")


class Batch:
    """Texts laid out by time: at each place all texts that are long enough, longest first."""

    def __init__(self, seqs: list[np.ndarray]):
        lens = np.array([len(s) for s in seqs])
        self.order = np.argsort(-lens, kind="stable")
        self.lens = lens[self.order]
        alive = np.searchsorted(-self.lens, -np.arange(self.lens[0]), "left")
        self.at = np.concatenate(([0], np.cumsum(alive)))
        self.symbols = np.empty(self.at[-1], np.int32)
        for i, k in enumerate(self.order):
            self.symbols[self.at[: self.lens[i]] + i] = seqs[k]

    def forward(self, hmm: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward variables and their scales, by time; emissions of each token."""
        emitted = np.ascontiguousarray(hmm.emit.T)[self.symbols]
        alpha, scale, at = np.empty_like(emitted), np.empty(len(emitted)), self.at.tolist()
        before = np.broadcast_to(hmm.start, (at[1], len(hmm.start)))
        for a, b in itertools.pairwise(at):
            here = np.multiply(before[: b - a], emitted[a:b], out=alpha[a:b])
            scale[a:b] = c = here.sum(axis=1)
            here /= c[:, None]
            before = here @ hmm.step
        return alpha, scale, emitted

    def log10(self, hmm: Hmm) -> np.ndarray:
        """Exact log10 likelihood of each text, in the order they were given."""
        _, scale, _ = self.forward(hmm)
        logs, out = np.log10(scale), np.empty(len(self.lens))
        text = np.concatenate([np.arange(b - a) for a, b in itertools.pairwise(self.at.tolist())])
        out[self.order] = np.bincount(text, weights=logs, minlength=len(self.lens))
        return out

    def expect(self, hmm: Hmm, starts: np.ndarray, steps: np.ndarray, emits: np.ndarray) -> None:
        """Adds the expected counts of starts, steps and emissions."""
        alpha, scale, emitted = self.forward(hmm)
        at, back = self.at.tolist(), np.ascontiguousarray(hmm.step.T)
        beta, pairs = None, np.zeros_like(steps)
        for t in range(len(at) - 2, -1, -1):
            a, b = at[t], at[t + 1]
            if beta is None:
                beta = np.ones((b - a, len(hmm.start)))
            else:
                n = at[t + 2] - b
                after = emitted[b : b + n] * beta / scale[b : b + n, None]
                pairs += alpha[a : a + n].T @ after
                beta = np.ones((b - a, len(hmm.start)))
                np.matmul(after, back, out=beta[:n])
            alpha[a:b] *= beta
        starts += alpha[: at[1]].sum(axis=0)
        steps += pairs * hmm.step
        for s in range(len(hmm.start)):
            emits[s] += np.bincount(self.symbols, weights=alpha[:, s], minlength=emits.shape[1])


def batches_of(seqs: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Lists of at most HELD_TOKENS tokens, or of one longer text."""
    held, n = [], 0
    for s in seqs:
        if held and n + len(s) > HELD_TOKENS:
            yield held
            held, n = [], 0
        held.append(s)
        n += len(s)
    if held:
        yield held


def _symbols(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column(column).to_pylist():
            yield np.frombuffer(x, np.int32)


def neighbour_counts(train: DataFrame) -> np.ndarray:
    """Counts of neighbouring symbols; all beyond the NEIGHBOURS most frequent but the end are one."""
    width = NEIGHBOURS + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width * width, np.int64)
        for seqs in batches_of(_symbols(batches)):
            flat = np.concatenate(seqs).astype(np.int64)
            small = np.where(flat == SYMBOLS + CLASSES, NEIGHBOURS + 1, np.minimum(flat, NEIGHBOURS))
            inside = flat[:-1] != SYMBOLS + CLASSES  # a pair does not reach over the end of a text
            held += np.bincount((small[:-1] * width + small[1:])[inside], minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["pair", "n"])

    out = np.zeros(width * width)
    for r in train.select("ids").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(width, width)


def first_model(pairs: np.ndarray, unigram: np.ndarray, states: int, seed: int = 5) -> Hmm:
    """Factor the neighbour counts into states by expectation maximization; of three starts the likeliest."""
    rng, best = np.random.default_rng(seed), (-np.inf, None, None)
    total = max(pairs.sum(), 1.0)
    margin = pairs.sum(axis=0) + pairs.sum(axis=1) + 1e-3
    for _ in range(3):
        emit = margin * np.exp(rng.normal(0, 0.7, (states, len(pairs))))
        emit /= emit.sum(axis=1, keepdims=True)
        joint = np.full((states, states), 1.0) + states * np.eye(states)
        joint /= joint.sum()
        for _ in range(STEPS):
            model = emit.T @ joint @ emit + 1e-300
            ratio = pairs / model
            left, right = joint @ emit @ ratio.T, joint.T @ emit @ ratio
            joint = joint * (emit @ ratio @ emit.T) + 1e-9 * total
            joint /= joint.sum()
            emit = emit * (left + right) + 1e-6 * margin
            emit /= emit.sum(axis=1, keepdims=True)
        fit = (pairs * np.log(emit.T @ joint @ emit + 1e-300)).sum()
        best = max(best, (fit, joint, emit), key=lambda x: x[0])
    _, joint, small = best
    full = np.empty((states, len(unigram)))
    full[:, :NEIGHBOURS] = small[:, :NEIGHBOURS]
    rest = unigram[NEIGHBOURS:-1]
    full[:, NEIGHBOURS:-1] = small[:, NEIGHBOURS : NEIGHBOURS + 1] * (rest / rest.sum())
    full[:, -1] = small[:, NEIGHBOURS + 1]
    full += 1e-4 * unigram
    return Hmm(joint.sum(axis=1), joint / joint.sum(axis=1, keepdims=True), full / full.sum(axis=1, keepdims=True))


def baum_welch(train: DataFrame, hmm: Hmm, unigram: np.ndarray) -> Hmm:
    """One round over all training texts (ids)."""
    states = len(hmm.start)
    sent = train.sparkSession.sparkContext.broadcast(hmm)
    names = [f"s{k}" for k in range(states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm = sent.value
        starts, steps, emits = np.zeros(states), np.zeros((states, states)), np.zeros_like(hmm.emit)
        for seqs in batches_of(_symbols(batches)):
            Batch(seqs).expect(hmm, starts, steps, emits)
        at = np.flatnonzero(emits.sum(axis=0))
        # -1 is the start, -2 and below are the steps from each state
        keys = np.concatenate((at, [-1], -2 - np.arange(states))).astype(np.int32)
        rows = np.vstack((emits[:, at].T, starts, steps))
        yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(states))], ["symbol", *names])

    emit, start, step = np.zeros_like(hmm.emit), np.zeros(states), np.zeros((states, states))
    summed = train.select("ids").mapInArrow(run, "symbol int, " + ", ".join(f"{n} double" for n in names)).groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names])
    for r in summed.collect():
        k, v = r[0], r[1:]
        if k >= 0:
            emit[:, k] = v
        elif k == -1:
            start[:] = v
        else:
            step[-2 - k] = v
    sent.unpersist()
    emit = (emit + PRIOR * unigram) / (emit.sum(axis=1, keepdims=True) + PRIOR)
    step = (step + 1e-3) / (step + 1e-3).sum(axis=1, keepdims=True)
    return Hmm((start + 1e-3) / (start + 1e-3).sum(), step, emit)


def train(encoded: DataFrame, lex: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """``encoded`` holds the training rows alone."""
    hmm = first_model(neighbour_counts(encoded), lex.unigram, states)
    for _ in range(rounds):
        hmm = baum_welch(encoded, hmm, lex.unigram)
    return hmm


def forward_scores(encoded: DataFrame, hmm: Hmm) -> DataFrame:
    """row -> log10 likelihood of its symbols."""
    sent = encoded.sparkSession.sparkContext.broadcast(hmm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []

        def seqs() -> Iterator[np.ndarray]:
            for batch in batches:
                rows.extend(batch.column(0).to_pylist())
                yield from _symbols(iter([batch]), 1)

        for held in batches_of(seqs()):
            done = rows[: len(held)]
            del rows[: len(held)]
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64()), pa.array(Batch(held).log10(sent.value))], ["row", "path"])

    return encoded.select("row", "ids").mapInArrow(run, "row long, path double")


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    n = fold(F.col("doc_id"), folds)
    counts = materialize(word_counts(docs.where((n != held) & (n >= 0))), "lm-counts")
    lex = lexicon(counts)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (n == held).alias("held_out"), "text")
    encoded = materialize(encode(rows, lex), "lm-encoded")
    learned = fold(F.col("doc_id"), folds)
    hmm = train(encoded.where((learned != held) & (learned >= 0)), lex)
    # cold words: corpus counts by join, added up for each row
    words = encoded.select("row", F.explode(F.arrays_zip("cold", "times")).alias("x")).select("row", F.col("x.cold").alias("word"), F.col("x.times").alias("k"))
    size = F.element_at(F.lit(lex.class_size.tolist()), (F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)) % CLASSES + 1).cast("int"))
    c, k = F.coalesce(F.col("n"), F.lit(0)), F.col("k")
    cold = words.join(counts, "word", "left").groupBy("row").agg(F.sum(k * F.log10(c + 1)).alias("cold_base"), F.sum(F.when(c > 0, k).otherwise(0)).alias("cold_known"), F.sum(k * F.log10((c + 1) / size)).alias("cold_inner"))
    cold = materialize(cold, "lm-cold")
    paths = materialize(forward_scores(encoded, hmm), "lm-paths")
    flat = materialize(encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner"), "lm-rows")
    for used in (counts, encoded):
        release(used)
    every = float(np.log10(lex.total + lex.distinct + 1.0))
    return (
        flat.join(paths, "row").join(cold, "row", "left")
        .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("cold_known", F.lit(0))).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
                (F.col("base") + F.coalesce("cold_base", F.lit(0.0)) - F.col("n_tokens") * every).alias("base_score"),
                (F.col("path") + F.col("inner") + F.coalesce("cold_inner", F.lit(0.0))).alias("score"))
    )
