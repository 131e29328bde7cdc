"""Operator 4: classes by brute force, templates without telling names, hostile pages."""

import random
import time
from collections import Counter, defaultdict

import pytest

from lexloom.llm import op4_html
from lexloom.llm.op4_html import Template, extract, read

PAGES = "page_id long, url string, html string"


def texts(spark, pages):
    return {r["page_id"]: r["text"] for r in op4_html.main_text(spark.createDataFrame(pages, PAGES)).collect()}


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(5))


def unnamed(rng, menu=30):
    """Pages of one host whose class names mean nothing, and the text each should give."""
    notice = "We keep crumbs on your device so that this place works, see there for what they are and how they go away again. " * 2
    for i in range(6):
        title, paras = f"Title {word(rng)}", [" ".join(word(rng) for _ in range(rng.randint(5, 60))) for _ in range(rng.randint(1, 5))]
        links = "".join(f"<li><a href=/{k}>Part {k}</a></li>" for k in range(menu))
        yield f"""<html><head><title>{title}</title></head><body><div class="x1"><ul>{links}</ul></div><div class='x2'>{notice}</div><div class="x3"><h1>{title}</h1>{''.join(f"<p>{p}</p>" for p in paras)}</div>
<div class="x4">Buy {word(rng)} now</div><div class="x5">Read next: <a href=/z>{word(rng)} {word(rng)} {word(rng)}</a></div><div class="x6">(c) {i} all mine</div></body></html>""", "\n\n".join([title, *paras])


@pytest.mark.parametrize("menu", [5, 600])
def test_meaningless_class_names(spark, menu):
    made = list(unnamed(random.Random(3), menu))
    got = texts(spark, [(i, f"http://x.io/{i}", h) for i, (h, _) in enumerate(made)])
    assert [got[i] for i in range(len(made))] == [t for _, t in made]
    assert all(extract(h)[0] != t for h, t in made)  # without the template the rest of the page is there too


def test_heading_beside_the_content_and_single_elements(spark):
    rng = random.Random(5)
    page = lambda t, b: f"<body><div class=q0><a href=/>Home</a> <a href=/b>Other</a></div><div class=q1><h2>{t}</h2><div class=q2>{b}</div></div><div class=q3>ad {t[:2]}</div></body>"
    made = [(word(rng), "".join(f"<p>{' '.join(word(rng) for _ in range(20))}</p>" for _ in range(3))) for _ in range(4)]
    got = texts(spark, [(i, "http://y.io/", page(*m)) for i, m in enumerate(made)] + [(9, "http://y.io/z", "<article><p>other layout</p></article><div>rest</div>")])
    assert all(got[i].startswith(t + "\n\n") and got[i].count("\n\n") == 3 for i, (t, _) in enumerate(made)) and got[9] == "other layout"


def test_copies_on_one_host_keep_their_text(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Same</h1><p>All pages of this host say the same.</p></article><footer>f</footer></body></html>"
    assert set(texts(spark, [(i, "http://same.io/", page) for i in range(5)]).values()) == {"Same\n\nAll pages of this host say the same."}


def test_pages_by_tags():
    by = lambda h: read(h, Template())
    assert by("<article><header class='entry-header'><h1>T</h1></header><p>a</p><section class='post-comments'>b</section></article>") == "T\n\na"
    assert by("<div class='cookie-notice'>c</div><div id=content><p>a &#233;&lt;b&gt;</p></div><div class='side-bar widget'>x</div><div role=contentinfo>y</div>") == "a é<b>"
    assert by("<main><p>a<div class='ad'>buy<p>more</div>b<br>c</p></main><p>out</p>") == "a\n\nb c"
    assert by("<p>unclosed <b>bold<p>next</i></article>") == "unclosed bold\n\nnext"
    assert by("<article><div class='share-price'>12 up</div><div class='search'>found</div><p>x</p></article>") == "12 up\n\nfound\n\nx"
    assert by('<article><p>a <img alt="a > b" src=x>c</p><p title=\'>">\'>d</p><p don\'t>e it\'s</p><p x=">f</p></article>').startswith("a c\n\nd\n\ne it's")


def test_hostile_pages_are_linear():
    for page in ("<b>" * 200_000 + "</i>" * 200_000, "<b><div>" * 100_000 + "</b>" * 200_000, "<div>" + "<i>" * 100_000 + "<p>x</p>" * 100_000, "<script" * 200_000, "<p x=\"" * 100_001, "<!--" * 100_000, "</p>" * 300_000):
        began = time.time()
        read(page, Template(frozenset(("<b>", "</b>"))))
        assert time.time() - began < 6


def test_classes_by_brute_force(spark):
    rng = random.Random(8)
    pages = [(i, h, f"<html><body><div id=t>{'<b>x</b>' * (1 + i % 3)}<p class=n>{word(rng)}</p><i>same</i>{'<u>often</u>' if i % 5 else ''}</div>{'<hr class=z>' * rng.randint(0, 2)}</body></html>") for i, h in enumerate(["a"] * 10 + ["b"] * 4 + ["c"] * 2)]
    frames = {r["host"]: (set(r["frame"]), set(r["constant"])) for r in op4_html.templates(op4_html.occurrences(spark.createDataFrame(pages, "page_id long, host string, html string"))).collect()}
    want = {}
    for host in ("a", "b"):
        counts = [Counter(t for _, t, _, _ in op4_html.tokens(h)) for _, at, h in pages if at == host]
        classes, places = defaultdict(list), {}
        for token in set().union(*counts):
            vector = tuple(c[token] for c in counts)
            if sum(map(bool, vector)) >= op4_html.SUPPORT * len(counts):
                classes[vector].append(token)
        for _, at, h in pages:
            if at == host:
                first = {}
                for k, (_, t, _, _) in enumerate(op4_html.tokens(h)):
                    first.setdefault(t, k)
                for t, k in first.items():
                    places.setdefault(t, []).append(k)
        mean = {t: sum(v) / len(v) for t, v in places.items()}
        frame = [t for v, ts in classes.items() if set(v) <= {0, 1} for t in ts]
        low, high = min(mean[t] for t in frame), max(mean[t] for t in frame)
        nested = [t for v, ts in classes.items() if max(v) > 1 and min(mean[t] for t in ts) >= low and max(mean[t] for t in ts) <= high for t in ts]
        want[host] = {t for t in frame if t[0] != "#"}, {t for t in frame + nested if t[0] == "#"}
    assert frames == want
