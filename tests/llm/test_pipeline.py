"""The pipeline's rows against brute force and its operators applied one by one, and its edge cases."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np

import corpus_pipeline as pipeline
from lexloom.llm import near_copies, op9_bpe
from lexloom.llm.common import shared_dir
from tests.llm.test_operators import base_of, leaks, made_docs, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def bag_of(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows, labels, items):
    """The pipeline over rows (doc_id, text, lang, ...), by plain loops; learned parts are taken as given by the fixture.

    The fixture's bad texts are those full of percent signs, and its languages can't be mistaken.
    """
    kept = [r for r in rows if not base_of(r[1])[-1] and not (labels and "%%%" in r[1])]
    root = list(range(len(kept)))
    bags = [bag_of(r[1]) for r in kept]
    for a in range(len(kept)):
        for b in range(a):
            both = sum((bags[a] & bags[b]).values())
            if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(k)
    some = [kept[min(g, key=lambda k: (kept[k][0] is None, kept[k][0] or 0, k))] for g in groups.values()]
    dirty = {k for k, _ in leaks([(k, r[1]) for k, r in enumerate(some)], items)}
    return sorted((r for k, r in enumerate(some) if k not in dirty), key=repr)


def test_against_brute_force(spark, tmp_path):
    """Null-id leaks, one id with two texts, equal texts without id, columns with names used inside."""
    rng = random.Random(3)
    vocab = {"xa": ["".join(rng.choice("bdgklmn") + rng.choice("aou") for _ in range(3)) for _ in range(400)], "xb": ["".join(rng.choice("çñßřž") + rng.choice("éíü") for _ in range(3)) for _ in range(400)]}
    made = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    rows = [(i, made("xa" if i % 2 else "xb", rng.choice([20, 60, 90, 150])), "xa" if i % 2 else "xb") for i in range(60)]
    item = made("xa", 40)
    leak = lambda: f"{made('xa', 30)} {item.upper()} {made('xa', 30)}"
    rows += [(None, leak(), "xa"), (61, leak(), "xa"), (61, made("xa", 80), "xa"), (61, made("xb", 80), "xb"), (62, leak(), None)]
    twice = made("xb", 70)
    rows += [(None, twice, "xb"), (None, twice, "xb"), (None, made("xa", 70), "xa"), (None, None, None), (63, None, "xa"), (64, "", "xb"), (65, "  \n", "xb")]
    rows += [(70 + k, r[1] + " " + made(r[2], 2), r[2]) for k, r in enumerate(rows[1:20:3])] + [rows[9], rows[9], (3, rows[5][1], "xa"), (0, rows[11][1][:40].upper() + rows[11][1][40:], "xa")]
    rows += [(100 + k, " ".join(w[:-3] + "%%%" for w in made("xa", rng.choice([60, 90, 150])).split()), "xa") for k in range(40)]
    rows += [(200 + k, made("xb" if k % 2 else "xa", rng.choice([60, 90, 150])), "xb" if k % 2 else "xa") for k in range(40)]
    full = [(i, t, g, "s", len(t or ""), 1, 2, 3, 4, 5, 6, 7) for i, t, g in rows]
    spark.createDataFrame(full, DOCS + ", _w int, _s int, kept int, rule int, doc int, t int, row int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, ""), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(100 + k, 0, 0) for k in range(40)] + [(200 + k, 1, 0) for k in range(40)] + [(None, 1, 0), (9999, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = brute(rows, labels, [(1, item)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    got = sorted(((r["doc_id"], r["text"], r["lang"]) for r in docs.collect()), key=repr)
    assert [g for g in got if g not in want] == [w for w in want if w not in got] == [] and len(got) == len(want)
    codec = op9_bpe.codec(op9_bpe.default_path())
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["ids_sha256"]) for r in got), key=repr) == sorted(((i, hashlib.sha256(" ".join(map(str, codec.encode(t))).encode()).hexdigest()) for i, t, _ in want), key=repr)


def test_empty(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_and_run(spark, tmp_path):
    rows = made_docs(80)
    item = " ".join(rows[1][1].split()[:3]) if len(rows[1][1].split()) < 30 else " ".join(rows[1][1].split()[2:30])
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == before.columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() <= before.count()
    last = {tuple(r) for r in docs.collect()}
    there = set(Path(shared_dir(spark), "lexloom").iterdir())
    assert last and {tuple(r) for r in pipeline.run(spark, str(tmp_path)).collect()} == last
    left = {p.name.rsplit("-", 1)[0] for p in set(Path(shared_dir(spark), "lexloom").iterdir()) - there}
    assert left == {"pipeline-bpe_encoding"}  # what the result reads
    kept = {r["doc_id"] for r in docs.collect()}
    assert 80 not in kept and 81 not in kept  # copies of document 5
    assert not kept & {83, 84, 85, 87}  # null, empty, blank and wordless texts


def test_near_duplicates_at_similarity(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    common, texts = [word() for _ in range(60)], []
    for k in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 9, 60, 100, 200]))]
        if k % 3 == 0:
            base = base + common
        texts.append(base)
        for changes in (0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
        texts += [base[len(base) // 10 :], base + base[: len(base) // 8], base + base]
    texts += [["again"] * n for n in (50, 55, 80, 200)] + [[], []]
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = sum((bags[a] & bags[b]).values())
            if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    docs = spark.createDataFrame([(i, " ".join(w), None, None, 0) for i, w in enumerate(texts)], DOCS)
    want = {i for i, r in enumerate(root) if i == r}
    for crowded, common_at in ((near_copies.CROWDED, near_copies.COMMON), (3, 2)):
        monkeypatch.setattr(near_copies, "CROWDED", crowded)
        monkeypatch.setattr(near_copies, "COMMON", common_at)
        assert {r["doc_id"] for r in pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_bitmaps_bound_what_bags_share():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 400, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
            b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.3, 0.8, 0.95, 1.0])], rng.integers(-(1 << 63), 1 << 63, rng.integers(0, n))]))
            bits = int(np.bitwise_count((near_copies.bits_of(a) ^ near_copies.bits_of(b)).view(np.uint64)).sum())
            assert bits <= len(a) + len(b) - 2 * len(np.intersect1d(a, b))


def test_texts_of_one_form_make_few_pairs(spark, monkeypatch):
    """300 texts of 400 words, 8 of them replaced: similarity about 0.7, no link."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(400)], []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(400), 8):
            copy[at] = word()
        rows.append((i, " ".join(copy), None, None, 0))
    asked, own = [], near_copies.similar
    monkeypatch.setattr(near_copies, "similar", lambda pairs, *rest: asked.append(pairs.distinct().count()) or own(pairs, *rest))
    assert pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").count() == 300
    assert sum(asked) < 20 * 300
