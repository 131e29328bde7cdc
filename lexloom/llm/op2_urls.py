"""URL verdicts by rules, carried over redirect and canonical-link aliases.

A rule (host, path) fits its host and all subdomains if the url's path starts
with the rule's; of several the longest wins, and a url's own rule decides.
Urls without a rule follow their aliases: pages name their canonical url or a
redirect target, and connected components over these edges join all names of a
page. If any name in a component is explicitly allowed, the component's urls
without a rule stay allowed; else, if any is blocked, they are blocked; else
they are allowed. Explicit allows so take precedence over carried blocks.

Urls that differ only behind ``#`` are one name. Every canonical link and every
refresh of a page is an edge, whatever the order and quoting of the attributes;
those in HTML comments, scripts and other raw text are none. Relative targets
are resolved against the page's url.

Defined cases: a null url, or one without ``://``, has an empty host and path,
no rule and verdict allow; null or empty html has no edges; repeated rows stay;
an empty table gives an empty result. All steps are linear in the url and html.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import ascii_lower, connected_components, materialize, small_batches

#: (verdict, rule) as given for the registered query.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Elements whose content is raw text.
RAW = ("script", "style", "textarea", "template", "title")
CUT = re.compile("<!--.*?(?:-->|\\Z)|" + "|".join(rf"<{x}\b.*?(?:</{x}\s*>|\Z)" for x in RAW), re.S | re.I)
TAG = re.compile(r"""<(link|meta)(?=[\s/])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
#: Content of a refresh: seconds, then the target, quoted or not.
REFRESH = re.compile(r"""\s*[\d.]*\s*[;,]?\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|([^\s"']+))""", re.I)


def _has_host(url: Column) -> Column:
    return F.coalesce(url.contains("://"), F.lit(False))


def host_of(url: Column) -> Column:
    return F.when(_has_host(url), ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(_has_host(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def name_of(url: Column) -> Column:
    """The url without its fragment, host in lower case: one name of a page."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(_has_host(url), F.concat(ascii_lower(F.regexp_extract(url, r"(?s)^(.*?://)", 1)), host_of(url), F.when(rest == "", "/").otherwise(rest)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def links_of(page: str | None) -> Iterator[str]:
    """Targets of all canonical links and refreshes of a page, as written."""
    for kind, more in TAG.findall(CUT.sub(" ", page or "")):
        found: dict[str, str] = {}
        for name, a, b, c in ATTRIBUTE.findall(more):
            found.setdefault(name.lower(), references.unescape(a or b or c))
        to = ""
        if kind.lower() == "link" and "canonical" in found.get("rel", "").lower().split():
            to = found.get("href", "")
        elif kind.lower() == "meta" and found.get("http-equiv", "").strip().lower() == "refresh":
            m = REFRESH.match(found.get("content", ""))
            to = next(filter(None, m.groups()), "") if m else ""
        if to.strip() and not to.strip().startswith("#"):
            yield to.strip()


def without_dots(path: str) -> str:
    """A path with its ``.`` and ``..`` segments carried out."""
    if "/." not in path:
        return path
    out: list[str] = []
    parts = path.split("/")
    for part in parts:
        if part == ".." and len(out) > 1:
            out.pop()
        elif part not in (".", ".."):
            out.append(part)
    return "/".join(out) + ("/" if parts[-1] in (".", "..") else "")


def resolved(url: str, to: str) -> str:
    """Absolute form of a target on the page of that url."""
    scheme, _, rest = url.partition("://")
    if "://" in to.split("?")[0]:
        scheme, _, rest = to.partition("://")
    elif to.startswith("//"):
        rest = to[2:]
    else:
        host, _, path = re.split("[?#]", rest, maxsplit=1)[0].partition("/")
        folder = "" if to.startswith("/") else f"/{path}" if to.startswith("?") else f"/{path[: path.rfind('/') + 1]}"
        rest = host + folder + to
    at = re.search("[?#]", rest)
    whole, more = (rest[: at.start()], rest[at.start() :]) if at else (rest, "")
    host, slash, path = whole.partition("/")
    return f"{scheme}://{host}{without_dots(slash + path)}{more}"


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): names of one page, from its canonical links and its redirects."""
    small_batches(pages.sparkSession, 300)

    @F.pandas_udf("array<string>")
    def targets(urls: pd.Series, htmls: pd.Series) -> pd.Series:
        return pd.Series([[resolved(u, t) for t in links_of(h)] for u, h in zip(urls, htmls, strict=True)])

    hint = F.lower("html")
    some = pages.where(_has_host(F.col("url")) & (hint.contains("canonical") | hint.contains("refresh")))
    found = some.select("url", F.explode(targets(F.col("url"), F.col("html"))).alias("to"))
    return found.select(name_of(F.col("url")).alias("a"), name_of(F.col("to")).alias("b")).where("a is not null and b is not null and a <> b").distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """pages (page_id, url, html) -> page_id, host, path, rule, verdict."""
    url = F.col("url")
    own = pages.select("page_id", name_of(url).alias("name"), host_of(url).alias("host"), path_of(url).alias("path"))
    own = own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    edges = materialize(alias_edges(pages), "url-edges")
    if edges.take(1):
        groups = connected_components(edges, "url-components")
        name = F.col("node")
        ruled = groups.withColumn("own", rule_of(host_of(name), path_of(name), rules))
        verdicts = ruled.groupBy("root").agg(F.max((F.col("own.verdict") == "allow").cast("int")).alias("allowed"), F.max((F.col("own.verdict") == "block").cast("int")).alias("blocked"))
        stopped = groups.join(verdicts.where("coalesce(allowed, 0) = 0 and blocked = 1").select("root"), "root").select(F.col("node").alias("name"), F.lit("block").alias("carried"))
        own = own.join(stopped, "name", "left")
    else:
        own = own.withColumn("carried", F.lit(None).cast("string"))
    return own.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "carried", F.lit("allow")).alias("verdict"))


def _sql_rule(host: str, path: str, what: str) -> str:
    cases = []
    for verdict, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        at, slash, rest = rule.partition("/")
        cases.append(f"when ({host} = '{at}' or ends_with({host}, '.{at}')) and starts_with({path}, '{slash}{rest}') then '{rule if what == 'rule' else verdict}'")
    return "case " + " ".join(cases) + " end"


def _sql_host(url: str) -> str:
    return f"coalesce(case when contains({url}, '://') then translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') end, '')"


def _sql_path(url: str) -> str:
    return f"coalesce(case when contains({url}, '://') then regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) end, '')"


#: Tags, attributes and targets of pages in DuckDB SQL.
_SQL_FOUND = r"""tags as (select url, unnest(regexp_extract_all(regexp_replace(html, '@cut', ' ', 'g'), '(?is)<(?:link|meta)[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*')) as tag
  from pages where contains(url, '://') and regexp_matches(html, '(?i)canonical|refresh')),
pieces as (select url, lower(substr(tag, 2, 4)) as kind, list_transform(regexp_extract_all(substr(tag, 6), '(?s)[^\s"''<>/=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?'),
    lambda x: {'n': lower(regexp_extract(x, '^[^\s"''<>/=]+')), 'v': regexp_replace(regexp_replace(x, '^[^\s"''<>/=]+\s*=?\s*', ''), '(?s)^["''](.*)["'']$', '\1')}) as attrs from tags),
named as (select url, kind, list_filter(attrs, lambda x: x.n = 'rel')[1].v as rel, list_filter(attrs, lambda x: x.n = 'href')[1].v as href, list_filter(attrs, lambda x: x.n = 'http-equiv')[1].v as equiv,
    regexp_extract(list_filter(attrs, lambda x: x.n = 'content')[1].v, '(?is)^\s*[\d.]*\s*[;,]?\s*(?:url\s*=\s*)?(.*)$', 1) as target from pieces),
found as (select url, trim(regexp_replace(case when kind = 'link' and list_contains(string_split_regex(lower(rel), '\s+'), 'canonical') then href
    when kind = 'meta' and lower(trim(equiv)) = 'refresh' then case when target[1] in ('"', '''') then split_part(substr(target, 2), target[1], 1) else regexp_extract(target, '^[^\s"'']+') end end, '(?i)&amp;', '&', 'g')) as t from named)"""
#: The target's absolute form.
_SQL_WHOLE = r"""case when contains(split_part(t, '?', 1), '://') then t when starts_with(t, '//') then regexp_extract(url, '(?s)^(.*?):', 1) || ':' || t
  when starts_with(t, '/') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t when starts_with(t, '?') then regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || '/' || regexp_extract(url, '(?s)^.*?://[^/?#]*/([^?#]*)', 1) || t
  else regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || '/' || regexp_extract(url, '(?s)^.*?://[^/?#]*/([^?#]*/)[^/?#]*', 1) || t end"""


def oracle() -> str:
    """The same verdicts in DuckDB SQL, reachability as a recursive query over canonical and redirect edges.

    Of character references it knows ``&amp;`` alone, and it leaves dot segments as they are.
    """
    name = "case when contains({u}, '://') then translate(regexp_extract({u}, '(?s)^(.*?://)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || " + _sql_host("{u}") + " || case regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1) when '' then '/' else regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1) end end"
    cut = "(?is)<!--.*?(?:-->|$)|" + "|".join(rf"<{x}\b.*?(?:</{x}\s*>|$)" for x in RAW)
    return f"""
with recursive {_SQL_FOUND.replace("@cut", cut)},
edge as (select distinct {name.format(u="url")} as a, {name.format(u=f"({_SQL_WHOLE})")} as b from found where t <> '' and not starts_with(t, '#')),
both_ways as (select a, b from edge where a <> b union select b, a from edge where a <> b),
reach as (select a as node, b as other from both_ways union select r.node, e.b from reach r join both_ways e on r.other = e.a),
ruled as (select node, {_sql_rule(_sql_host("other"), _sql_path("other"), "verdict")} as v from (select node, other from reach union select node, node from reach)),
carried as (select node from ruled group by node having bool_or(coalesce(v = 'block', false)) and not bool_or(coalesce(v = 'allow', false))),
own as (select page_id, {_sql_host("url")} as host, {_sql_path("url")} as path, {name.format(u="url")} as name from pages)
select page_id, host, path, {_sql_rule("host", "path", "rule")} as rule,
  coalesce({_sql_rule("host", "path", "verdict")}, case when c.node is not null then 'block' end, 'allow') as verdict
from own left join carried c on own.name = c.node"""
