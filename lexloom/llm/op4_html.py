"""Main text of web pages by deduced host templates.

A page is cut into tokens: tags (name, id, class and role) and runs of text (by
hash, of any length). For every host, each token's occurrence vector over the
host's pages is kept as counts and random projections, which add up across
partitions; tokens with the same vector form an equivalence class. The classes of
tokens that occur once in each page that has them are the template's frame; further
classes with wide support whose places lie inside the frame are nested into it.
Pages of hosts with fewer than LEAST_PAGES pages share the template of all pages.

The frame's elements own slots: the text inside of them that no inner frame
element owns. Over all pages of the host each slot's words are counted: all,
those outside of links, and those that vary, which are in no class. The slot with
most varying words outside of links leads to the template's content element, and
only text inside that element is extracted, wherever a page has it:
menus, notices, adverts and footers go by their place, whatever they are called.
An article or main element of the frame is taken for the content if it holds a
fair share of the varying words. Where no single element of the frame holds the
content, constant text and slots that are mostly links go and the rest stays.

Inside the content element, parts that are no main text by their tag or by a whole
word of their class go. Frame elements can't be closed by stray tags inside a
slot, so unclosed markup stays harmless. Pages that don't have their template's
content element are read by their tags and class words alone.

Defined cases: null and empty html give an empty text; a null url belongs to
the host ""; repeated rows count in the template and stay; empty tables give
empty results. Reading is linear in the page, whatever its tags.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import materialize, small_batches
from lexloom.llm.op2_urls import host_of

LEAST_PAGES, SUPPORT = 3, 0.8
#: Share of the leading slot's varying words that an article or main element must hold; share of links that makes a menu.
FAIR, LINKED = 0.2, 0.5
#: Bytes of templates that are broadcast at most.
BROADCAST = 64 << 20
EVERY = "*"

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*+(?:>.*?(?:</\1\s*>|\Z)|\Z)|<![^>]*>|<\?[^>]*>"""
    r"""|</?[a-zA-Z](?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+>?|<|[^<]+""", re.S | re.I
)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
MARK = re.compile(r"""\b(id|class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Numbers that tell pages apart rather than elements: long ones, and those that end a word of several parts.
DIGITS = re.compile(r"\d{3,}|(?<=[-_])\d+(?![^\s])")
# Fixed values of the HTML standard: elements that never have content, that start a block, and that hold no main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SHUT = frozenset("nav header footer aside form head menu select button dialog script style noscript template".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that a new block of the given kind closes where they are still open.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
ONLY_P: frozenset[str] = frozenset("p")
#: Words of an id, class or role that name parts which are no main text, inside and outside of the content.
ASIDE = frozenset("ad ads advert adverts advertisement sponsor sponsored promo sidebar menu nav navigation navbar breadcrumb breadcrumbs cookie cookies consent gdpr newsletter subscribe signup comments comment-list commentlist replies respond disqus pagination pager social sharing related recommended widget".split())
OUTSIDE = ASIDE | frozenset("header footer masthead banner notice notices popup modal login search share toolbar contentinfo complementary".split())
#: Parts of such a word that are enough by themselves.
PARTS = frozenset("advert comments sidebar cookie consent newsletter breadcrumb breadcrumbs nav menu sponsored buttons".split())


def marks(tag: str) -> tuple[str, str]:
    """Name of a tag and its id, class and role, numbers of pages made alike."""
    name = NAME.match(tag).group(1).lower()
    found = " ".join(f"{m.group(1).lower()}={m.group(2) or m.group(3) or m.group(4) or ''}" for m in MARK.finditer(tag)) if "=" in tag else ""
    return name, DIGITS.sub("0", found)


def tokens(page: str | None) -> Iterator[tuple[str, str, str, str]]:
    """(kind, token, name, marks or text): kinds are open, close and text; comments and raw elements are left out."""
    for m in TOKEN.finditer(page or ""):
        piece = m.group()
        if m.group(1) or piece.startswith(("<!", "<?")):
            continue
        if piece[0] == "<" and len(piece) > 1:
            name, found = marks(piece)
            if piece[1] == "/":
                yield "close", f"</{name}>", name, ""
            else:
                yield "open", f"<{name} {found}>" if found else f"<{name}>", name, found
        elif not piece.isspace():
            yield "text", "#" + xxhash.xxh64_hexdigest(piece.strip().encode("utf-8", "replace")), "", piece


def occurrences(pages: DataFrame) -> DataFrame:
    """(page_id, host, html) -> one row for each host and token: the token's occurrence vector in digest.

    ``pages`` counts its pages, ``n`` its occurrences, v1 and v2 are random
    projections of the vector, place is its summed first place. The row of the
    token "" stands for the page itself, so it has one occurrence in every page.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[str, str], list[int]] = {}
            for page, host, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seed = zlib.crc32(f"{page}|{len(text or '')}".encode()), zlib.crc32((text or "").encode("utf-8", "replace"))
                r1, r2 = seed[0] & 0xFFFFFF, seed[1] & 0xFFFFFF
                found: Counter[str] = Counter({"": 1})
                first: dict[str, int] = {"": 0}
                for at, (_, token, _, _) in enumerate(tokens(text), 1):
                    found[token] += 1
                    first.setdefault(token, at)
                for token, n in found.items():
                    x = held.setdefault((host, token), [0, 0, 0, 0, 0])
                    for k, v in enumerate((1, n, n * r1, n * r2, first[token])):
                        x[k] += v
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in range(5))], ["host", "token", "pages", "n", "v1", "v2", "place"])

    return pages.select("page_id", "host", "html").mapInArrow(count, "host string, token string, pages long, n long, v1 long, v2 long, place long").groupBy("host", "token").agg(*_sums())


def _sums() -> list:
    return [F.sum(c).alias(c) for c in ("pages", "n", "v1", "v2", "place")]


def templates(seen: DataFrame) -> DataFrame:
    """host, of (pages), frame (tags once in each page) and constant (text of the frame and of further wide classes)."""
    pages = seen.where("token = ''").select("host", F.col("pages").alias("of")).where(F.col("of") >= LEAST_PAGES)
    # a token of fewer pages can't have wide support, so most rows go before the join
    often = seen.where("token <> ''").where(F.col("pages") >= SUPPORT * LEAST_PAGES)
    wide = often.join(pages, "host").where(F.col("pages") >= SUPPORT * F.col("of"))
    # tokens with one vector are one class; those of the frame occur once in each page that has them
    at = F.col("place") / F.col("pages")
    classes = wide.groupBy("host", "of", "pages", "n", "v1", "v2").agg(F.max((F.col("n") == F.col("pages")).cast("int")).alias("frame"), F.collect_list("token").alias("tokens"), F.min(at).alias("low"), F.max(at).alias("high"))
    span = classes.where("frame = 1").groupBy("host").agg(F.min("low").alias("from"), F.max("high").alias("to"))
    valid = classes.join(span, "host", "left").where("frame = 1 or `from` is null or (low >= `from` and high <= `to`)")
    both = valid.select("host", "of", "frame", F.explode("tokens").alias("token")).withColumn("text", F.col("token").startswith("#"))
    return both.groupBy("host", "of").agg(F.collect_list(F.when((F.col("frame") == 1) & ~F.col("text"), F.col("token"))).alias("frame"), F.collect_list(F.when(F.col("text"), F.col("token"))).alias("constant"))


class Template(NamedTuple):
    frame: frozenset[str] = frozenset()
    constant: frozenset[str] = frozenset()
    content: str | None = None  # the content element's tag
    menus: frozenset[str] = frozenset()  # frame elements whose slots are mostly links


def walk(page: str | None, frame: frozenset[str], root, enter: Callable) -> Iterator[tuple[str | None, str, object]]:
    """(text, token, state of the innermost element) of each run; text is None where a block ends.

    ``enter(state, name, token, marks)`` gives the state of an element from its parent's.
    """
    stack: list[tuple[str, bool, object]] = []  # name, of the frame, state
    opens: dict[str, list[int]] = defaultdict(list)  # places in the stack, by name
    blocks: list[int] = []  # those of blocks, and of the frame's blocks
    framed: list[int] = []

    def cut(depth: int) -> None:
        while len(stack) > depth:
            opens[stack.pop()[0]].pop()
            for held in (blocks, framed):
                if held and held[-1] == len(stack):
                    held.pop()

    state = root
    for kind, token, name, more in tokens(page):
        if kind == "text":
            yield more, token, state
            continue
        if kind == "open":
            if name in VOID:
                if name in ("br", "hr"):
                    yield (" " if name == "br" else None), "", state
                continue
            ends = ENDS.get(name, ONLY_P if name in BLOCK else ())
            while blocks and stack[blocks[-1]][0] in ends and not (name == "p" and stack[blocks[-1]][1]):
                yield None, "", state
                cut(blocks[-1])
            if name in BLOCK:
                yield None, "", state
            state = enter(stack[-1][2] if stack else root, name, token, more)
            if name in BLOCK:
                blocks.append(len(stack))
                if token in frame:
                    framed.append(len(stack))
            opens[name].append(len(stack))
            stack.append((name, token in frame, state))
            continue
        if not opens[name]:
            continue
        at = opens[name][-1]
        if name in BLOCK:
            if framed and framed[-1] > at and token not in frame:
                continue  # a stray closing tag can't leave the frame's slot
            yield None, "", state
            cut(at)
        elif not blocks or blocks[-1] < at:  # an inline tag closed across blocks changes no slot
            cut(at)
        state = stack[-1][2] if stack else root


def slot_words(page: str | None, frame: frozenset[str], constant: frozenset[str]) -> dict[tuple[str, str], list[int]]:
    """(owner, its owner) -> words, those outside of links, and those of them that vary."""

    def enter(state, name, token, _):
        owner, parent, linked = state
        linked = linked or name == "a"
        return (token, owner, linked) if token in frame and name != "a" else (owner, parent, linked)

    out: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0, 0])
    for text, token, (owner, parent, linked) in walk(page, frame, ("", "", False), enter):
        if text and (n := len(text.split())):
            x = out[owner, parent]
            x[0] += n
            x[1] += 0 if linked else n
            x[2] += 0 if linked or token in constant else n
    return out


def choose(slots: list) -> tuple[str | None, list[str]]:
    """Content element and menus of a template, from (owner, parent, words, plain, varying) of its slots."""
    slots = sorted(slots, key=lambda s: s["owner"])
    parent = {s["owner"]: s["parent"] for s in slots}
    column = "varying" if any(s["varying"] for s in slots) else "plain"
    own: Counter[str] = Counter()
    whole: Counter[str] = Counter()  # of an element and those inside of it
    for s in slots:
        own[s["owner"]] += s[column]
        seen, at = set(), s["owner"]
        while at and at not in seen:
            whole[at] += s[column]
            seen.add(at)
            at = parent.get(at, "")
    name = lambda owner: NAME.match(owner).group(1) if owner else ""
    menus = [s["owner"] for s in slots if s["words"] and s["plain"] < (1 - LINKED) * s["words"]]
    if not own or not max(own.values()):
        return None, menus
    main = max(own, key=lambda o: (own[o], o))
    articles = [o for o in whole if name(o) in CONTENT or "role=main" in o]
    fair = [o for o in articles if whole[o] >= FAIR * own[main]]
    if fair:
        return max(fair, key=lambda o: (whole[o], o)), menus
    climbed = 0
    while name(main) not in ("div", "section", "td", "body", "html", "") and climbed < len(parent):
        main, climbed = parent.get(main, ""), climbed + 1
    above = parent.get(main, "")
    if name(above) not in ("body", "html", "") and any(name(o) in HEADINGS and own[o] and parent.get(o) == above for o in list(own)):
        main = above  # the heading of the content stands beside it
    return (None if name(main) in ("body", "html", "") else main), menus


def is_aside(found: str, words: frozenset[str]) -> bool:
    """Whether a whole word of an id, class or role names a part that is no main text."""
    for word in found.lower().replace("=", " ").split():
        if word in words or not PARTS.isdisjoint(re.split("[-_]", word)):
            return True
    return False


#: Where text stands: outside, in an article or main element, in the template's content element.
REST, ARTICLE, INSIDE = range(3)


def extract(page: str | None, template: Template = Template(), by_tags: bool = False) -> tuple[str, int]:
    """Text of one page, and where it stands: in the template's content element if the page has it.

    Else it is what the template leaves; with ``by_tags``, tags and class words also
    bar parts, and an article or main element goes before the rest of the page.
    """

    def enter(state, name, token, more):
        zone, shut, menu = state
        if token == template.content and zone != INSIDE:
            return INSIDE, False, False
        article = name in CONTENT or "role=main" in more
        if zone == REST:
            barred = name in SHUT or by_tags and bool(more) and not article and name not in ("body", "html") and is_aside(more, OUTSIDE)
            return (ARTICLE if article and by_tags else REST), shut or barred, menu or token in template.menus
        barred = name in SHUT and name != "header" or bool(more) and not article and is_aside(more, ASIDE)
        return zone, shut or barred, False

    blocks: tuple[list[str], ...] = ([], [], [])
    held: list[str] = []
    at, seen = REST, {REST}

    def end() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks[at].append(text)

    for text, token, (zone, shut, menu) in walk(page, template.frame, (REST, False, False), enter):
        if text is None or zone != at:
            end()
            at = zone
        seen.add(zone)
        if text and not shut and not menu and (zone != REST or token not in template.constant):
            held.append(references.unescape(text) if token else text)
    end()
    return "\n\n".join(blocks[max(seen)]), max(seen)


def read(page: str | None, template: Template) -> str:
    """By the template's content element; a page without it by tags, if it has an article or no template."""
    text, zone = extract(page, template)
    if zone == INSIDE:
        return text
    other, zone = extract(page, template._replace(content=None, menus=frozenset()), by_tags=True)
    return other if zone == ARTICLE or template.content or not template.frame else text


def _joined(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Pages with their host's template, or nulls; templates are broadcast if their bytes are few."""
    size = lambda c: F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.length(x) + 16), F.lit(0))
    arrays = [c for c, t in known.dtypes if t.startswith("array")]
    own = known.where(F.col("host") != EVERY)
    few = (own.agg(F.sum(sum((size(c) for c in arrays), F.lit(100)))).first()[0] or 0) <= BROADCAST
    return rows.join(F.broadcast(own) if few else own, "host", "left")


def _of_every(known: DataFrame) -> tuple | None:
    """The columns of the template of all pages, which is no larger than a few pages are."""
    found = known.where(F.col("host") == EVERY).drop("host").first()
    return tuple(found) if found else None


def _kept(make: Callable, every: tuple | None, most: int = 1000) -> Callable:
    """``make`` of a host's columns (of those of all pages if it has none), remembered for as many hosts."""
    held: dict[str, object] = {}

    def get(host: str, *columns):
        if columns[0] is None:
            host, columns = EVERY, every or (None,) * len(columns)
        if host not in held:
            if len(held) >= most:
                held.clear()
            held[host] = make(*columns)
        return held[host]

    return get


def deduced(rows: DataFrame) -> DataFrame:
    """(page_id, url, html, host) -> host, frame, constant, content, menus: a template for each host of enough pages, and for all pages."""
    seen = materialize(occurrences(rows), "html-tokens")
    every = seen.groupBy("token").agg(*_sums()).withColumn("host", F.lit(EVERY)).select(seen.columns)
    made = materialize(templates(seen.unionByName(every)).select("host", "frame", "constant"), "html-templates")
    shared = _of_every(made)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _kept(lambda frame, constant: (frozenset(frame or ()), frozenset(constant or ())), shared)
        for batch in batches:
            held: dict[tuple[str, str, str], list[int]] = defaultdict(lambda: [0, 0, 0])
            for host, page, frame, constant in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for (owner, parent), n in slot_words(page, *template(host, frame, constant)).items():
                    x = held[EVERY if frame is None else host, owner, parent]
                    for k in range(3):
                        x[k] += n[k]
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in held], pa.string()) for i in range(3)), *(pa.array([v[i] for v in held.values()], pa.int64()) for i in range(3))], ["host", "owner", "parent", "words", "plain", "varying"])

    slots = _joined(rows, made).select("host", "html", "frame", "constant").mapInArrow(count, "host string, owner string, parent string, words long, plain long, varying long")
    sums = slots.groupBy("host", "owner", "parent").agg(*[F.sum(c).alias(c) for c in ("words", "plain", "varying")])

    @F.pandas_udf("content string, menus array<string>")
    def chosen(found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([choose(list(x)) for x in found], columns=["content", "menus"])

    # a host has no more slots than its frame has elements
    picked = sums.groupBy("host").agg(F.collect_list(F.struct("owner", "parent", "words", "plain", "varying")).alias("slots")).select("host", chosen("slots").alias("c"))
    return materialize(made.join(picked, "host", "left").select("host", "frame", "constant", "c.content", "c.menus"), "html-deduced")


def main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    small_batches(pages.sparkSession, 300)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    known = deduced(rows)
    joined, shared = _joined(rows, known).select("page_id", "url", "html", "host", "frame", "constant", "content", "menus"), _of_every(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = _kept(lambda frame, constant, content, menus: Template(frozenset(frame or ()), frozenset(constant or ()), content, frozenset(menus or ())), shared)
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(2, 8))
            out = [read(page, template(*more)) for page, *more in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
