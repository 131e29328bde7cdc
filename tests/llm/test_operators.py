"""Operators against brute force on small fixtures, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lexloom.llm import op1_hmm, op2_urls, op3_shards, op4_html, op5_rules, op6_language, op7_simhash, op8_quality, op9_bpe, op10_decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def words(t):
    return WORD.findall(lower(t))


def made_docs(n=60, seed=1):
    """Two invented languages, copies, near copies, junk, nulls, blanks and one long text."""
    rng = random.Random(seed)
    vocab = {"xa": [a + b for a in ("the", "on", "re", "st", "Nd") for b in ("er", "ing", "ly", "ou", "a")], "xb": [a + b for a in ("qué", "ñu", "ci", "LL", "ja") for b in ("ez", "osó", "ar", "ui", "e")]}
    rows = []
    for i in range(n):
        lang = ("xa", "xb")[i % 2]
        text = " ".join(rng.choice(vocab[lang]) for _ in range(rng.choice([3, 60, 90, 200])))
        rows.append((i, text + ".\nLast line", lang))
    rows += [(n, rows[5][1], "xb"), (n + 1, rows[5][1], "xb"), (n + 2, rows[3][1] + " x", "xb"), (n + 3, None, None), (n + 4, "", "xa"), (n + 5, " \t\n ", None), (n + 6, "Again again again " * 200, "xa"), (n + 7, "\x85é 123 %%% |", None), (n + 8, rows[7][1] * 300, "xb"), (5, rows[5][1], "xb"), (None, "no id here", "xa")]
    return [(i, t, g, "s", len(t or "")) for i, t, g in rows]


@pytest.fixture(scope="module")
def docs(spark):
    rows = made_docs()
    # extra columns whose names operators use inside
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS + ", fp int, key int, word int").cache(), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def held(i, folds, k):
    return i is not None and zlib.crc32(str(i).encode()) % folds == k


# ---- 1: language model ----


def path_probability(hmm, symbols):
    """Sum over all state paths, unscaled."""
    a = hmm.start * hmm.emit[:, symbols[0]]
    for s in symbols[1:]:
        a = a @ hmm.step * hmm.emit[:, s]
    return math.log10(a.sum())


def random_hmm(states, symbols, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return op1_hmm.Hmm(norm(rng.random(states)), norm(rng.random((states, states))), norm(rng.random((states, symbols))))


def test_forward_is_exact_for_ragged_batches():
    hmm, rng = random_hmm(3, 7), np.random.default_rng(1)
    seqs = [rng.integers(0, 7, n).astype(np.int32) for n in (5, 1, 30, 5, 2)]
    assert np.allclose(op1_hmm.Batch(seqs).log10(hmm), [path_probability(hmm, s) for s in seqs])


def test_expected_counts_match_enumeration():
    hmm, seqs = random_hmm(2, 3), [np.array([0, 2, 1], np.int32), np.array([1], np.int32)]
    starts, steps, emits = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    op1_hmm.Batch(seqs).expect(hmm, starts, steps, emits)
    want = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    for s in seqs:
        paths = np.stack(np.meshgrid(*[[0, 1]] * len(s), indexing="ij"), -1).reshape(-1, len(s))
        p = np.array([hmm.start[x[0]] * hmm.emit[x[0], s[0]] * math.prod(hmm.step[a, b] * hmm.emit[b, o] for a, b, o in zip(x, x[1:], s[1:], strict=False)) for x in paths])
        for x, w in zip(paths, p / p.sum(), strict=True):
            want[0][x[0]] += w
            for a, b in zip(x, x[1:], strict=False):
                want[1][a, b] += w
            for a, o in zip(x, s, strict=True):
                want[2][a, o] += w
    assert all(np.allclose(a, b) for a, b in zip((starts, steps, emits), want, strict=True))


def test_language_model_base_scores_and_gain(docs, empty):
    df, rows = docs
    toks = [words(t) + [""] for _, t, *_ in rows]
    train = [x for r, x in zip(rows, toks, strict=True) if r[0] is not None and not held(r[0], 7, 2)]
    c = Counter(w for x in train for w in x)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if r[0] is None else r[0], len(x), sum(c[w] > 0 for w in x), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x), 6)) for r, x in zip(rows, toks, strict=True))
    got = op1_hmm.score(df).collect()
    assert sorted((-1 if g["doc_id"] is None else g["doc_id"], g["n_tokens"], g["n_known"], round(g["base_score"], 6)) for g in got) == want
    assert {g["train_tokens"] for g in got} == {n} and all(g["held_out"] == held(g["doc_id"], 7, 2) for g in got)
    known = [g for g in got if g["held_out"] and g["n_tokens"] > 20]
    assert sum(g["score"] for g in known) > sum(g["base_score"] for g in known)
    assert op1_hmm.score(empty).count() == 0


def test_training_raises_likelihood():
    rng = np.random.default_rng(3)
    seqs = [np.array([(k * 2 + rng.integers(0, 2)) for _ in range(12)], np.int32) for k in rng.integers(0, 2, 40)]
    hmm, last = random_hmm(2, 4, 9), -np.inf
    for _ in range(5):
        now = op1_hmm.Batch(seqs).log10(hmm).sum()
        assert now >= last - 1e-9
        last = now
        s, t, e = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 4))
        op1_hmm.Batch(seqs).expect(hmm, s, t, e)
        hmm = op1_hmm.Hmm(s / s.sum(), t / t.sum(axis=1, keepdims=True), e / e.sum(axis=1, keepdims=True))


# ---- 2: urls ----


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "https://a.example.com/en/1", ""), (2, "https://A.Example.COM/en/7x?y#z", None), (3, "http://x.net/de/3", ""), (4, "http://b.example.net/de/8/9", ""), (5, None, ""), (6, "no scheme/en/", ""), (7, "http://com/en/", ""), (8, "http://notcom/en/", ""),
        (9, "http://free.io/a", link.format("http://y.org/es/3")), (10, "http://free.io/b", link.format("/a")), (11, "http://free.io/c", '<META HTTP-EQUIV="refresh" CONTENT="0; url=b">'), (12, "http://other.io/a", ""),
        (13, "http://free.io/d", link.format("http://example.com/en/7")), (14, "http://free.io/e", '<link href="http://free.io/d#f" rel=canonical>'), (15, "http://free.io/d", link.format("http://q.org/es/1")), (16, "http://free.io/a#top", ""), (1, "https://a.example.com/en/1", ""),
    ]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in op2_urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("a.example.com", "/en/1", "com/en/", "block") and by[2] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert by[4][2:] == ("example.net/de/8", "block") and by[5] == by[6] == ("", "", None, "allow") and by[7][3] == "block" and by[8][3] == "allow"
    assert [by[i][3] for i in (9, 10, 11, 16)] == ["block"] * 4 and by[12][3] == "allow"  # chain of aliases of a blocked url
    assert [by[i][3] for i in (13, 14, 15)] == ["allow"] * 3  # an explicit allow among the names takes precedence
    assert op2_urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_sql_agrees(spark):
    import duckdb

    rows = [(i, f"http://h{i}.io/p", f'<link rel="canonical" href="http://h{i + 1}.{"net/de/" if i == 4 else "io/p"}">' if i != 6 else "") for i in range(9)] + [(20, None, None), (21, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", rows)
    cols = ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, op2_urls.judge(df).select(cols).collect()), key=repr) == sorted(c.sql(op2_urls.oracle()).select(*cols).fetchall(), key=repr)


# ---- 3: shards ----


def least_capacity(sizes, shards):
    def need(c):
        n, room = 0, 0
        for s in sizes:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n

    c = max(sizes)
    while need(c) > shards:
        c += 1
    return c


@pytest.mark.parametrize("seed", range(8))
def test_cuts_are_minimax(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(16, 60, 50) ** (1 + seed % 3)
    for shards in (1, 2, 6, 49, 60):
        at = np.searchsorted(op3_shards.cuts(sizes, shards), np.arange(len(sizes)), "right")
        loads = np.bincount(at, weights=sizes, minlength=shards)
        assert (np.diff(at) >= 0).all() and at[-1] < shards and loads.max() == least_capacity(sizes.tolist(), shards)


def test_order_holds_each_atom_once_and_levels():
    rng = np.random.default_rng(1)
    for heavy, light in ((rng.integers(100, 5000, 70), rng.integers(1, 40, 3000)), (np.array([], int), rng.integers(1, 9, 50)), (np.array([10**6, 5, 4]), np.array([], int)), (np.array([10**6]), rng.integers(50, 60, 900))):
        order = op3_shards.arranged(heavy, light, 8)
        assert sorted(order.tolist()) == list(range(len(heavy) + len(light)))
        sizes = np.concatenate((heavy, light))[order]
        loads = np.bincount(np.searchsorted(op3_shards.cuts(sizes, 8), np.arange(len(sizes)), "right"), weights=sizes, minlength=8)
        rest = sorted(loads)[:-1] if sizes.max() > sizes.sum() / 8 else loads
        if len(light) > 50:
            assert max(rest) - min(rest) <= 0.02 * np.mean(rest)


def test_hot_and_null_ids_get_gapless_slots(spark):
    df = spark.range(20_000).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 7 else id end as doc_id", "case when id % 2 = 0 then 'hot' else concat('t', id % 4000) end as text", "id as row", "1 as shard", "2 as bin")
    got = op3_shards.by_bytes(df).select("shard", "slot", "size").collect()
    by = defaultdict(list)
    for g in got:
        by[g["shard"]].append(g["slot"])
    assert len(got) == 20_000 and all(sorted(v) == list(range(len(v))) for v in by.values())
    loads = Counter()
    for g in got:
        loads[g["shard"]] += g["size"]
    rest = sorted(loads.values())[:-1]  # the hot text fills one shard
    assert len(loads) == 40 and max(rest) - min(rest) <= 0.1 * np.mean(rest)


def test_shards(docs, empty):
    df, rows = docs
    got = op3_shards.by_bytes(df).collect()
    by, group = defaultdict(list), defaultdict(set)
    text = {r[0]: r[1] or "" for r in rows}
    for g in got:
        by[g["shard"]].append(g)
        group[text[g["doc_id"]]].add(g["shard"])
        assert (g["size"], g["text_crc32"], g["law"], g["grown_shard"]) == (len(text[g["doc_id"]].encode()) + 16, zlib.crc32(text[g["doc_id"]].encode()), "bytes", None)
    assert len(got) == len(rows) and all(len(s) == 1 for s in group.values()) and all(0 <= k < 40 for k in by)
    assert all(sorted(g["slot"] for g in v) == list(range(len(v))) for v in by.values())
    assert op3_shards.by_bytes(empty).count() == 0


# ---- 4: html ----


def page(title, paras, extra=""):
    return f"<html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=\"ad\">Buy {title}</div><aside>side</aside><article><h1>{title}</h1>{paras}{extra}</article><div id='comments'>nice</div><footer>&copy; me</footer></body></html>"


def test_main_text(spark):
    pages = [(i, f"http://h.io/{i}", page(f"T{i}", f"<p><b>One {i} &amp;\n two<br>more<p>Three&nbsp;four</div></p><p>five</p>")) for i in range(5)]
    pages += [(10, "http://solo.io/", page("S", "<p>a</p><form>f</form><ul><li>b<li>c</ul><div class='share-buttons'>no</div>")), (11, None, None), (12, "x", ""), (13, "http://h.io/9", "<p>plain<p>text"), (14, "http://l.io/", page("L", "<p>" + "w " * 50_000 + "</p>")), (0, pages[0][1], pages[0][2])]
    got = {r["page_id"]: r for r in op4_html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3]["text"] == "T3\n\nOne 3 & two more\n\nThree four\n\nfive" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[10]["text"] == "S\n\na\n\nb\n\nc" and got[11]["text"] == got[12]["text"] == "" and got[13]["text"] == "plain\n\ntext"
    assert got[14]["n_chars"] == 3 + 2 * 50_000 - 1
    assert op4_html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_constant_text_is_template_without_an_article(spark):
    body = "<html><body><div><span>Read our blog</span></div><div><p>Story {0} here</p></div></body></html>"
    got = op4_html.main_text(spark.createDataFrame([(i, "http://c.io/", body.format(i)) for i in range(6)], "page_id long, url string, html string")).collect()
    assert sorted(r["text"] for r in got) == [f"Story {i} here" for i in range(6)]


# ---- 5: rules ----


def base_of(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    win, cov = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
    for i in range(len(w) - 2):
        if win[tuple(w[i : i + 3])] > 1:
            cov |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cov), len(w) < 50 or 100 * len(cov) > 50 * len(w)


def test_base_statistics(spark, docs, empty):
    df, rows = docs
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = op5_rules.quality_rules(df, labels).collect()
    key = lambda x: repr(x)
    assert sorted(((g["doc_id"], *tuple(g)[1:7]) for g in got), key=key) == sorted(((r[0], *base_of(r[1])) for r in rows), key=key)
    assert all(g["kept"] == (not g["base_failed"]) for g in got)  # no labels: the base rules alone
    assert op5_rules.quality_rules(empty, labels).count() == 0


def test_rules_are_learned(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(80)]
        bad = i % 4 == 0
        rows.append((i, " ".join(x + "%%" if bad else x for x in w), int(not bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (9999, 0), (3, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in op5_rules.quality_rules(docs, labels).collect()}
    assert sum(got[i] == bool(q) for i, _, q in rows) >= 398


def test_growing_and_pruning_by_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(300):
        x = {f: rng.random() for f in op5_rules.RATIOS}
        rows.append({"bad": (x["words"] > 0.6 and x["upper"] < 0.5) or rng.random() < 0.05, "prune": i % 3 == 0, **x})
    df = spark.createDataFrame(rows, "bad boolean, prune boolean, " + ", ".join(f"{f} double" for f in op5_rules.RATIOS))
    grid = {f: sorted(rng.random() for _ in range(6)) for f in op5_rules.RATIOS}
    grow, prune = [r for r in rows if not r["prune"]], [r for r in rows if r["prune"]]
    holds = lambda r, c: r[c[0]] >= c[2] if c[1] == ">=" else r[c[0]] < c[2]
    rule = []
    while len(rule) < op5_rules.MOST_CONDITIONS:
        now = [r for r in grow if all(holds(r, c) for c in rule)]
        p, n = sum(r["bad"] for r in now), sum(not r["bad"] for r in now)
        best = (1e-9, None)
        for f in op5_rules.RATIOS:
            for x in grid[f]:
                for sign in (">=", "<"):
                    c = (f, sign, x)
                    a, b = sum(r["bad"] for r in now if holds(r, c)), sum(not r["bad"] for r in now if holds(r, c))
                    if a and p and n and (gain := a * (math.log2(a / (a + b)) - math.log2(p / (p + n)))) > best[0] + 1e-9:
                        best = gain, c
        if best[1] is None:
            break
        rule.append(best[1])
    got = op5_rules._grow(df.where("not prune"), grid)
    assert [tuple(c) for c in got] == rule and len(rule) > 1
    worth = []
    for k in range(len(rule)):
        met = [r["bad"] for r in prune if all(holds(r, c) for c in rule[: k + 1])]
        worth.append(((2 * sum(met) - len(met)) / max(len(met), 1), -k, sum(met), len(met) - sum(met)))
    best = max(worth)
    kept, p, n = op5_rules._prune(df.where("prune"), got)
    assert (len(kept) - 1, p, n) == (-best[1], best[2], best[3])


# ---- 6: languages ----


def test_counts_and_decoding_by_brute_force(spark, docs):
    rows = [(g, t) for _, t, g, *_ in docs[1] if g]
    got = {(r["lang"], r["gram"]): r["n"] for r in op6_language.gram_counts(spark.createDataFrame(rows, "lang string, text string").repartition(3)).collect()}
    want = Counter()
    for lang, text in rows:
        for gram in op6_language.grams(text).tolist() if text else ():
            want[lang, gram] += 1
    assert got == want
    rng = np.random.default_rng(3)
    for n in (2, 4, 7, 9):
        code = op6_language.codewords(n)
        if n <= 7:  # exhaustive: any two words differ in half of the bits, one more
            assert {int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)} == {2 ** (n - 2)}
        ratio, weight = rng.normal(size=(op6_language.BUCKETS, code.shape[1])), rng.random(code.shape[1]) + 0.5
        model = op6_language.Model([f"l{k}" for k in range(n)], code, ratio.astype(np.float32), weight)
        for text in ("some words here", "ñandú é", "x"):
            grams = op6_language.grams(text)
            margin = [sum(float(model.ratio[g, b]) for g in grams) / len(grams) * op6_language.STEEPNESS for b in range(code.shape[1])]
            loss = [sum(w * math.log1p(math.exp(-c * m)) for w, c, m in zip(weight, word, margin, strict=True)) for word in code]
            order = sorted(range(n), key=lambda k: loss[k])
            lang, score, ambiguous = op6_language.decode(model, text)
            assert lang == f"l{order[0]}" and ambiguous == (loss[order[1]] - loss[order[0]] < op6_language.GAP)
            assert abs(score - 1 / sum(math.exp(loss[order[0]] - x) for x in loss)) < 1e-4


def test_languages(docs, empty):
    df, rows = docs
    want = {r[0]: r[2] for r in rows}
    got = op6_language.identify(df).collect()
    assert len(got) == len(rows)
    for g in got:
        text = next(r[1] for r in rows if r[0] == g["doc_id"])
        assert g["held_out"] == held(g["doc_id"], 3, 1) and 0 <= g["score"] <= 1
        assert (g["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    clear = [g for g in got if want[g["doc_id"]] and g["held_out"] and g["lang_pred"] != "und"]
    assert clear and all(g["lang_pred"] == want[g["doc_id"]] for g in clear)
    assert op6_language.identify(empty).count() == 0


def test_codewords():
    assert op6_language.codewords(4).shape == (4, 7) and op6_language.codewords(2).shape == (2, 1)
    many = op6_language.codewords(20)
    apart = [(many[i] != many[j]).sum() for i in range(20) for j in range(i)]
    assert min(apart) >= 8
    assert op6_language.decode(op6_language.Model([], np.ones((0, 1)), np.zeros((op6_language.BUCKETS, 1)), np.ones(1)), "abc")[0] == "und"


# ---- 7: near duplicates ----


def print_of(t):
    w = words(t)
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=4):
    """prints: {fp: least id}; brute force over all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ps = list(prints)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for p in ps:
        least[find(p)] = min(least.get(find(p), prints[p]), prints[p])
    return {p: least[find(p)] for p in ps}


def test_near_duplicates(docs, empty):
    df, rows = docs
    prints = {}
    for i, t, *_ in rows:
        prints[print_of(t)] = min(prints.get(print_of(t), 1 << 62), 1 << 62 if i is None else i)
    want = components(prints)
    got = op7_simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for g in got:
        p = int(g["fingerprint"], 16)
        component = None if want[p] == 1 << 62 else want[p]
        assert len(g["fingerprint"]) == 16 and g["component_id"] == component
    assert sorted(g["fingerprint"] for g in got) == sorted(f"{print_of(r[1]):016x}" for r in rows)
    assert op7_simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowded", [2, 48])
def test_links_find_all_components(spark, monkeypatch, crowded):
    monkeypatch.setattr(op7_simhash, "CROWDED", crowded)
    rng = random.Random(7)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 4, 60])):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    from lexloom.llm.common import connected_components

    edges = op7_simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))
    root = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    want = components({p: signed(p) for p in prints})
    groups, mine = defaultdict(set), defaultdict(set)
    for p in prints:
        groups[want[p]].add(p)
        mine[root.get(signed(p), signed(p))].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_a_crowd_without_links_is_compared_by_pieces(spark, monkeypatch):
    """Fingerprints that share a segment but not each other's neighbourhood, and a few pairs among them."""
    from lexloom.llm.common import connected_components

    monkeypatch.setattr(op7_simhash, "CROWDED", 20)
    rng = random.Random(12)
    prints = {rng.getrandbits(42) << 22 | 12345 for _ in range(300)}
    for p in rng.sample(sorted(prints), 40):
        x = p
        for b in rng.sample(range(22, 64), rng.choice([2, 3, 4])):
            x ^= 1 << b
        prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    root = {r["node"]: r["root"] for r in connected_components(op7_simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))).collect()}
    want = components({p: signed(p) for p in prints})
    assert {p: root.get(signed(p), signed(p)) for p in prints} == want and len(set(want.values())) < len(prints)


def test_connected_components(spark):
    from lexloom.llm.common import connected_components

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (50, 51), (51, 50), (60, 60), (None, 3)] + [(200, 201 + i) for i in range(30)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in [*range(1, 41), 100]} == {1} and got[51] == 50 and 60 not in got and {got[i] for i in range(200, 231)} == {200}


# ---- 8: quality ----


def test_quality_network(spark, docs, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["good", "words", "in", "a", "text", "of", "sense"]) if i % 3 else rng.choice(["BUY!!", "NOW%%", "WIN$$", "CASH!!"]) for _ in range(60))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = op8_quality.score(spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string"), labels).collect()
    assert len(got) == 302 and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3) and g["held_out"] == held(g["doc_id"], 5, 0) for g in got)
    assert sum(g["predicted"] == int(g["doc_id"] % 3 > 0) for g in got if g["held_out"] and g["doc_id"] < 300) >= 0.95 * sum(g["held_out"] and g["doc_id"] < 300 for g in got)
    none = op8_quality.score(docs[0], labels.limit(0)).collect()
    assert {round(g["score"], 6) for g in none} == {0.5}
    assert op8_quality.score(empty, labels).count() == 0


def test_context_sums_by_brute_force(spark):
    texts = ["Good WORDS, good words 12!!", "a b", None, "", "x" * 5000 + " END OF Text", "a b a b a b c"]
    got = {r["bucket"]: tuple(r)[1:] for r in op8_quality.context_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect()}
    place, sign = op8_quality.index_vectors()
    n, sums = Counter(), defaultdict(lambda: np.zeros(op8_quality.WIDTH, int))
    for t in texts:
        at = [zlib.crc32(w) % op8_quality.BUCKETS for w in op8_quality.split(t)]
        for i, b in enumerate(at):
            n[b] += 1
            for j in range(max(0, i - op8_quality.WINDOW), min(len(at), i + op8_quality.WINDOW + 1)):
                if j != i:
                    for k in range(op8_quality.NONZERO):
                        sums[b][place[at[j], k]] += int(sign[at[j], k])
    assert got == {b: (n[b], *sums[b].tolist()) for b in n}
    assert op8_quality.split("Good WORDS, good 12!!\x00é Éa") == [b"good", b"\x00A", b"words", b",", b"good", b"12", b"!!", "é".encode(), "Éa".encode()]


# ---- 9: BPE ----


def test_bpe_matches_the_library(spark, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(op9_bpe.default_path())
    t.no_truncation()
    t.no_padding()
    df, rows = docs
    odd = ["İstanbul ΣΑΣ σς ß ﬁ", "it's we'll 'S", "a<|endoftext|>b <|startoftext|>", "12345 ½ ²", "é ẛ̣", "  　x​y", "emoji 👩‍👩‍👧 🇩🇪", "字漢 かな한국어", "!!!???...", "x" * 3000, "ab" * 700 + "!" * 500, "\x1c\x1d a\x00b", "ज़ क्षि", "ǅ Ǆ"]
    rows = rows + [(900 + i, s) for i, s in enumerate(odd)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = sorted(map(tuple, op9_bpe.digests(df).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, s, *_ in rows:
        ids = t.encode(s or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=repr)
    assert op9_bpe.digests(empty).count() == 0


def test_scan_and_queue_agree():
    codec = op9_bpe.codec(op9_bpe.default_path())
    rng = random.Random(5)
    for _ in range(200):
        ids = [codec.ids[c] for c in (rng.choice("aabcdeinrst") for _ in range(rng.randint(2, 60)))]
        assert codec._scan(list(ids)) == codec._queue(list(ids))


# ---- 10: decontamination ----


def leaks(docs, items):
    out = {}
    for b, it in items:
        w = (it or "").lower().split()
        n, k = len(w), min(5, len(w))
        s = Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        for i, t, *_ in docs:
            x = (t or "").lower().split()
            sh = [tuple(x[j : j + k]) for j in range(len(x) - k + 1)] if n else []
            for at in range(len(x) - n + 1 if n else 0):
                win = Counter(sh[at : at + n - k + 1])
                both = sum((s & win).values())
                sim = both / (2 * (n - k + 1) - both)
                if sim >= 0.8:
                    out[i, b] = max(out.get((i, b), 0), sim)
    return out


def test_contamination(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [(b, " ".join(word() for _ in range(n))) for b, n in enumerate([12, 30, 60, 60, 3, 100])] + [(90, None), (91, ""), (92, "the the the the the the the the the")]
    items.append((93, items[1][1]))
    docs = []
    for i in range(40):
        w = [word() for _ in range(80)]
        piece = (items[i % 6][1]).split()
        if i % 4 == 1:
            piece[len(piece) // 2 : len(piece) // 2 + 1] = []
        elif i % 4 == 2:
            piece[2] = "changed"
        elif i % 4 == 3:
            piece.insert(1, "added")
        docs.append((i, " ".join(w[:40] + (piece if i % 5 else []) + w[40:])))
    docs += [(50, items[1][1].upper().replace(" ", "\n")), (51, items[1][1]), (51, items[1][1]), (52, None), (53, ""), (54, "the " * 30), (55, items[2][1] + " " + items[2][1])]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in op10_decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = leaks(docs, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert op10_decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0
    assert op10_decontaminate.contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("broadcast", [op10_decontaminate.BROADCAST, 0])
def test_contamination_by_moved_blocks_and_short_texts(spark, monkeypatch, broadcast):
    monkeypatch.setattr(op10_decontaminate, "BROADCAST", broadcast)
    rng = random.Random(18)
    some = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    items, docs = [(b, some(n)) for b, n in enumerate([59, 100, 45, 59, 30])], []
    for b, w in items:
        half, third = len(w) // 2 + 1, len(w) // 3
        moved = [w[half:] + w[:half], w[third : 2 * third] + w[:third] + w[2 * third :], w[:5] + w[third:] + w[5:third]]
        moved += [w[third:] + w[:third], [x for a, b in zip(range(0, len(w), 2 * third), range(third, len(w) + third, 2 * third), strict=False) for x in w[b : b + third] + w[a:b]]]  # rotated, and blocks taken by turns
        docs += [some(17) + m + some(40) for m in moved] + moved
        docs += [w[1:], w[:-2], w[2:-1], w[: len(w) * 5 // 6], w[: len(w) * 2 // 3], w[half:] + w[1:half], some(len(w) - 1), w[3:] + some(3)]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)] + [(None, " ".join(items[0][1][1:])), (0, " ".join(items[4][1][:-1]))]
    items = [(b, " ".join(w)) for b, w in items] + [(9, "aa bb cc dd ee ff gg hh aa bb cc dd ee")]
    docs += [(100, "gg hh aa bb cc dd ee ff gg hh aa bb cc"), (101, "aa bb cc dd ee ff gg hh aa bb cc dd")]
    want = leaks(docs, items)
    for b, it in items:  # a text shorter than the item is one window
        s = Counter(zip(*[it.split()[j:] for j in range(5)], strict=False))
        for i, t in docs:
            if len(t.split()) < len(it.split()):
                x = Counter(zip(*[t.split()[j:] for j in range(5)], strict=False))
                both = sum((s & x).values())
                sim = both / (sum(s.values()) + sum(x.values()) - both)
                if sim >= 0.8:
                    want[i, b] = max(want.get((i, b), 0), sim)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in op10_decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert (0, 0) in want and (None, 0) in want and len(want) > 30
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
