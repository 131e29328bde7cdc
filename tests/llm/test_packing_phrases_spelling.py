import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lexloom.llm import op11_collocations as phrases
from lexloom.llm import op12_packing as packing
from lexloom.llm import op13_spelling as spelling

DOCS = "doc_id long, text string, lang string, n long, task string, place long, rank long, word string, code long"


def docs(spark, rows):
    """Rows of (doc_id, text, lang) beside columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 1, "t", 2, 3, "w", 4) for r in rows], DOCS)


# ---- phrases


def mined(rows, top):
    """The contract, by plain loops."""
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for cut in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(cut, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f = counts.setdefault(lang, Counter())
                    f[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        wanted = {p: a for p, a in f.items() if len(p) > 1 and a >= phrases.LEAST}
        found = []
        for p, a in wanted.items():
            if len(p) == 2 and any(100 * b >= 50 * a for q, b in wanted.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), a, left, right, totals[lang], -score) for i, (score, _, p, a, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def wordy(seed):
    random.seed(seed)
    words = ["The", "of", "ünter", "É", "x\x00y", "a", "b", "c", "new\x85york", "long" * 50, "日本"]
    joins = [" ", "  ", "\t", ", ", ". ", "\n", " ", " "]
    text = lambda: "".join(random.choice(words[: random.choice([3, 11])]) + random.choice(joins) for _ in range(random.randint(0, 80)))
    rows = [(i, text(), random.choice(["en", "de", None, "und"])) for i in range(60)]
    return rows + rows[:5] + [(None, text(), "en"), (7, None, "en"), (8, "", "fr"), (9, " .,\t", "fr"), (10, "once only here", "it"), (11, "the of the of " * 300, "en")]


@pytest.mark.parametrize(("held", "pairs", "side", "crowded"), [(1 << 19, 1 << 21, 512, 1 << 15), (6, 4, 4, 2), (1, 1, 2, 1), (1 << 19, 3, 2, 1)])
def test_phrases_by_brute_force(spark, monkeypatch, held, pairs, side, crowded):
    monkeypatch.setattr(phrases, "BUFFER", 200)
    rows = wordy(held + pairs)
    made = phrases.Tiles.__init__.__defaults__
    monkeypatch.setattr(phrases.Tiles.__init__, "__defaults__", (side, 3, crowded))
    found = phrases.mine(docs(spark, rows).repartition(3), 15, held, pairs)
    assert sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == mined(rows, 15)
    assert made == (512, 32, 1 << 15)


def test_phrases_of_nothing(spark):
    assert phrases.mine(docs(spark, [])).collect() == [] and phrases.mine(docs(spark, [(1, None, None), (2, "a b", "en")])).collect() == []


def test_scores_beyond_64_bits(spark):
    a, left, right = 9 * 10**15, 10**16, 9 * 10**15 + 7
    one = spark.createDataFrame([("en", "a b", a, [("a", "b", left, right)]), ("en", "a b c", a, [("a", "b c", a, a), ("a b", "c", a, a)])], "lang string, phrase string, a long, cuts array<struct<left:string,right:string,l:long,r:long>>")
    got = {r["phrase"]: (r["score"], r["l"], r["r"]) for r in phrases.scored(one, one.limit(0), True).collect()}
    assert got == {"a b": (10**6 * a * a // (left * right), left, right), "a b c": (10**6, a, a)}


@pytest.mark.parametrize(("side", "dense", "crowded"), [(2, 3, 1), (4, 0, 1), (8, 2, 50), (512, 32, 1 << 15)])
def test_tiles_count_every_cell(side, dense, crowded):
    rng = np.random.default_rng(side)
    tiles, want, got = phrases.Tiles(side, dense, crowded), Counter(), Counter()
    for _ in range(5):
        left, right = (rng.zipf(1.3, 400) % 50 for _ in range(2))
        want.update(zip(left.tolist(), right.tolist(), strict=True))
        for code, n in zip(*tiles.add(left, right), strict=True):
            got[code >> 32, code & 0xFFFFFFFF] += n
    assert len(tiles.dense) <= dense
    for codes, counts in tiles.flush():
        for code, n in zip(codes, counts, strict=True):
            got[code >> 32, code & 0xFFFFFFFF] += n
    assert got == want


# ---- packing


def test_fullest_by_brute_force():
    random.seed(2)
    for _ in range(300):
        room = random.randint(1, 40)
        counts = {random.randint(1, 30): random.randint(1, 3) for _ in range(random.randint(1, 5))}
        items = [k for k, n in counts.items() for _ in range(n)]
        best = max((sum(s) for n in range(len(items) + 1) for s in itertools.combinations(items, n) if sum(s) <= room), default=0)
        used = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(k * n for k, n in used.items()) == best and all(n <= counts[k] for k, n in used.items())


def test_plan_uses_every_piece_once():
    random.seed(3)
    for _ in range(100):
        capacity = random.randint(5, 60)
        counts = {random.randint(1, capacity): random.randint(1, 50) for _ in range(random.randint(0, 12))}
        plan, used = packing.minimum_slack(counts, capacity), Counter()
        for one, times in plan:
            assert times > 0 and sum(k * n for k, n in one.items()) <= capacity
            used.update({k: n * times for k, n in one.items()})
        assert used == Counter(counts)
        bins, least = sum(t for _, t in plan), max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
        assert least <= bins <= 1.5 * least + 1
        assert len(plan) <= 40 * max(1, len(counts))
    assert sum(t for _, t in packing.minimum_slack({6: 4, 4: 4, 5: 2}, 10)) == 5


ODD = ["", " ", "Ein Text.", "don't IT'S <|endoftext|>x <|ENDOFTEXT|> á Éé Σας K Å 12ab\tq z\x1c\x85y​q 日本語 \U0001f600\x01 a\x1fb \x7f a<b", "x" * 300, "ab1 ab. 1ab a- -a _a a_", "word " * 40, "ff ﬁ ǅ İ ı ß ẞ"]


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    own, library = packing.encoder(packing.default_path()), Tokenizer.from_file(packing.default_path())
    for text in [*ODD, *ODD]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert own.ids(None) == b""


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packing(spark, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_path())
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(None, None, None), (None, "again", "x"), (3, "again", "x"), (3, "again", "x"), (99, "very long " * 3000, None)]
    want = Counter()
    for i, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.update((i, k, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), capacity)))
    from pyspark.sql import functions as F

    got = packing.pack(docs(spark, rows).repartition(3), capacity=capacity).withColumn("crc", F.crc32("ids")).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["crc"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= -(-sum(n for held in bins.values() for _, n in held) // capacity) + 1
    assert packing.digests(docs(spark, [])).collect() == []


# ---- spelling


def grouped(rows, least_length, least, times):
    import re

    n = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % spelling.SLIPS == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, some in around.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(around[w]), n[form[w]] if form[w] else 0) for w in n)


def misspelt(seed):
    random.seed(seed)
    base = ["".join(random.choices("abé", k=random.randint(1, 7))) for _ in range(25)] + ["Straße", "naïveté", "aaaa", "aaaaa"]

    def slip(w):
        at = random.randrange(len(w) + 1)
        return random.choice([w, w, w, w[:at] + random.choice("abé") + w[at:], w[:at] + w[at + 1 :], w[: max(0, at - 1)] + "b" + w[at:]])

    text = lambda: random.choice([" ", "-", "1"]).join(slip(random.choice(base[: random.choice([2, 8, 29])])) for _ in range(random.randint(0, 60)))
    return [(i, text(), "x") for i in range(40)] * 2 + [(None, text(), None), (3, None, None), (4, "", None), (5, "12 -", None)]


@pytest.mark.parametrize("bucket", [5000, 3])
def test_spelling_by_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    monkeypatch.setattr(spelling, "SLIPS", 7)
    rows = misspelt(bucket)
    got = spelling.variants(docs(spark, rows), 2, 2, 3)
    assert sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in got.collect()) == grouped(rows, 2, 2, 3)
    assert any(f and f != r for _, f, r, *_ in grouped(rows, 2, 2, 3))


def test_very_long_words(spark):
    long = "ab" * 10_000
    rows = [(i, f"{long} {long}a {long}a", None) for i in range(5)]
    got = spelling.variants(docs(spark, rows)).collect()
    assert sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in got) == grouped(rows, 6, 5, 5) and len(got) == 2
    assert spelling.variants(docs(spark, [])).collect() == []


def test_numbers_of_nodes_are_one_for_each_prefix():
    random.seed(4)
    words = sorted({"".join(random.choices("ab", k=random.randint(1, 8))) for _ in range(120)})
    splits = sorted(random.sample(words, 6)) + ["zz"]
    import bisect

    trie, seen = spelling.Trie(splits), {}
    for w in words:
        for d, node in enumerate(trie.path(bisect.bisect_right(splits, w), w)):
            assert seen.setdefault(w[:d], node) == node
    assert len(set(seen.values())) == len(seen)
