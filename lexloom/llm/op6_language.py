"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary naive-Bayes
classifier over hashed byte bigrams and trigrams tells the languages that have
the bit from those that have not; it is trained from n-gram counts of all
labelled training documents, summed across partitions. A text's margins (mean
log-ratio for each bit) are decoded by weighted logistic loss: the language
whose codeword costs least is chosen, and the text is flagged as ambiguous if
the runner-up costs hardly more.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows without lang or id aren't learned from; repeated rows count each; with no
labelled rows at all every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import fold, small_batches

BUCKETS = 1 << 14
#: Spread of the mean log-ratio before the loss, and the loss gap under which a text is ambiguous.
STEEPNESS, GAP = 8.0, 0.5
#: ASCII letters in lower case; other ASCII is a gap between words; other bytes stay.
TABLE = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


class Model(NamedTuple):
    langs: list[str]
    code: np.ndarray  # languages x bits, of -1 and 1
    ratio: np.ndarray  # buckets x bits
    weight: np.ndarray  # of each bit


def grams(text: str) -> np.ndarray:
    """Buckets of all bigrams and trigrams of the whole text."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(TABLE) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(0x9E3779B1) ^ b[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    return np.concatenate((two >> np.uint32(18), three >> np.uint32(18)))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """Exhaustive code for up to seven languages, else random dense words kept apart."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        bits = np.array([[x >> k & 1 for x in range(2 ** (n - 1) - 1)] for k in range(n - 1)])
        return np.vstack([np.ones(bits.shape[1]), 2.0 * bits - 1])
    rng, best = np.random.default_rng(seed), (-1, None)
    for _ in range(64):
        words = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        apart = int(((words @ words.T) * -1 + words.shape[1] - 1e9 * np.eye(n) * -1).min() // 2)
        best = max(best, (apart, words.tolist()), key=lambda x: x[0])
    return np.array(best[1])


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, text) -> lang, gram, n over all rows; partial counts leave each partition."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pd.DataFrame]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "gram": at.astype(np.int32), "n": n[at]})
            held.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if text:
                    if lang not in held:
                        held[lang] = np.zeros(BUCKETS, np.int64)
                    held[lang] += np.bincount(grams(text), minlength=BUCKETS)
            if len(held) > 200:
                yield from out()
        yield from out()

    return labelled.select("lang", "text").mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame) -> Model:
    """What reaches the driver is one number for each language and bucket."""
    rows = gram_counts(labelled).groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams")).collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    share = np.full((len(rows), BUCKETS), 0.5)
    for k, r in enumerate(rows):
        for gram, n in r["grams"]:
            share[k, gram] += n
    share /= share.sum(axis=1, keepdims=True)
    code = codewords(len(rows))
    ratio, weight = np.zeros((BUCKETS, code.shape[1])), np.ones(code.shape[1])
    for b in range(code.shape[1] if len(rows) > 1 else 0):
        yes, no = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
        ratio[:, b] = np.log(yes / no)
        weight[b] = 0.5 * ((yes - no) * ratio[:, b]).sum()  # symmetric divergence: how well the bit can be told
    return Model([r["lang"] for r in rows], code, ratio.astype(np.float32), weight / max(weight.mean(), 1e-12))


def decode(model: Model, text: str | None) -> tuple[str, float, bool]:
    """Language, its share of the softmax over losses, and whether it is ambiguous."""
    if not has_letter(text) or not model.langs:
        return "und", 0.0, False
    found = grams(text)
    margin = np.bincount(found, minlength=BUCKETS).astype(np.float32) @ model.ratio / len(found) * STEEPNESS
    loss = np.logaddexp(0, -model.code * margin) @ model.weight
    order = np.argsort(loss, kind="stable")
    score = 1 / np.exp(loss[order[0]] - loss).sum()
    return model.langs[order[0]], float(score), bool(len(order) > 1 and loss[order[1]] - loss[order[0]] < GAP)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> all its columns, lang_pred, score, ambiguous."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def of_texts(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(sent.value, t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    return docs.withColumn("_found", of_texts(F.col("text"))).select(*[docs[c] for c in docs.columns], "_found.lang_pred", "_found.score", "_found.ambiguous")


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learns from the other folds of docs (doc_id, text, lang) and labels every row."""
    small_batches(docs.sparkSession)
    n = fold(F.col("doc_id"), folds)
    model = fit(docs.where((n != held) & (n >= 0) & F.col("lang").isNotNull()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (n == held).alias("held_out"), "lang_pred", "score", "ambiguous")
