"""Text-shaped queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.functions.vocabulary import LEGAL_VOCABULARY
from lexloom.operators import search
from lexloom.plans.registry import Registry, table

reg = Registry()


def q(s: str) -> str:
    return s.replace("'", "''")


NONSPACE = "length(regexp_replace(text, '\\s', '', 'g'))"
DENSITY = f"(cast(len(regexp_extract_all(text, '(?i)\\b({T.LEGAL_TERMS})\\b')) as double) / greatest(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 1))"
CONTENT = f"(case when {NONSPACE} > 0 then cast(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) as double) / {NONSPACE} else 0 end)"
FORMS = f"len(regexp_extract_all(text, '{q(T.FORM_NOISE)}'))"
PUNCT = f"(case when {NONSPACE} > 0 then cast(length(regexp_replace(text, '[^()\\[\\]{{}}*○□●/\\\\|─]', '', 'g')) as double) / {NONSPACE} else 0 end)"
SCORE = f"(least(greatest(least(length(text) / 50.0, 1.0) * 20 + least({DENSITY} * 300, 30.0) + {CONTENT} * 30 - least({FORMS} * 2, 20), 0.0), 100.0))"


@reg.query("""with i as (select unnest(list_filter([case when length(text) < 20 then 'VERY_SHORT' end, case when length(text) > 5000 then 'OVERSIZED' end, case when not regexp_matches(text, '[a-z]') then 'NO_LOWER' end, case when contains(text, '|') then 'TABLE' end], lambda x: x is not null)) as issue from documents)
select issue, count(*) as n from i group by issue order by n desc, issue limit 20""")
def issue_histogram_topn(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    tests = F.array(F.when(n < 20, "VERY_SHORT"), F.when(n > 5000, "OVERSIZED"), F.when(~F.col("text").rlike("[a-z]"), "NO_LOWER"), F.when(F.col("text").contains("|"), "TABLE"))
    return table(spark, d, "documents").select(F.explode(F.array_compact(tests)).alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "issue").limit(20)


@reg.query("select lang, median(n_chars) as median_chars, round(avg(n_chars), 4) as mean_chars, count(*) as n from documents group by lang")
def median_mean_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.median("n_chars").alias("median_chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.count("*").alias("n"))


@reg.query("select p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') as uid from part")
def slugify_uid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.slugify(F.concat_ws(" ", "p_name", "p_brand")).alias("uid"))


@reg.query("""with u as (select o_orderkey, case o_orderkey % 5 when 0 then 'sec-' || o_orderkey when 1 then 'sec-' || o_orderkey || '-ss-1' when 2 then 'sec-' || o_orderkey || '-ss-2-cl-a' when 3 then 'rule-' || o_orderkey else 'def-' || o_orderkey end as uid from orders)
select o_orderkey, uid, case when regexp_matches(uid, '-cl-[a-z]+$') then 'Clause' when regexp_matches(uid, '-ss-[0-9]+$') then 'SubSection' when starts_with(uid, 'sec-') then 'Section' when starts_with(uid, 'def-') then 'Definition' when starts_with(uid, 'rule-') then 'Rule' end as label from u""")
def uid_label_inference(spark: SparkSession, d: str) -> DataFrame:
    k, m = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 5
    uid = F.when(m == 0, F.concat(F.lit("sec-"), k)).when(m == 1, F.concat(F.lit("sec-"), k, F.lit("-ss-1"))).when(m == 2, F.concat(F.lit("sec-"), k, F.lit("-ss-2-cl-a"))).when(m == 3, F.concat(F.lit("rule-"), k)).otherwise(F.concat(F.lit("def-"), k))
    return table(spark, d, "orders").select("o_orderkey", uid.alias("uid")).withColumn("label", T.label_of_uid(F.col("uid")))


@reg.query("select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]+', '', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', E'\\n\\n', 'g'), '^\\s+|\\s+$', '', 'g')) as digest from documents")
def whitespace_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("digest"))


@reg.query("select doc_id, md5(replace(replace(translate(text, '“”‘’', '\"\"'''''), '—', '--'), '–', '-')) as digest from documents")
def quote_dash_normalize(spark: SparkSession, d: str) -> DataFrame:
    out = F.replace(F.replace(T.straight_quotes(F.col("text")), F.lit(T.EM_DASH), F.lit("--")), F.lit(T.EN_DASH), F.lit("-"))
    return table(spark, d, "documents").select("doc_id", F.md5(out).alias("digest"))


_FORM = "concat(o_orderpriority, repeat('.', cast(o_orderkey % 9 as int)), repeat('( ) ', cast(o_orderkey % 5 as int)), repeat('-', cast(o_orderkey % 8 as int)), repeat('* ', cast(o_orderkey % 6 as int)), repeat('_', cast(o_orderkey % 7 as int)), '   end  ')"


@reg.query(f"select o_orderkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_FORM}, '\\.{{5,}}', '', 'g'), '_{{5,}}', '', 'g'), '-{{5,}}', '-', 'g'), '(\\(\\s*\\)\\s*){{3,}}', '', 'g'), '(\\*\\s*){{4,}}', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as text from orders")
def form_template_strip(spark: SparkSession, d: str) -> DataFrame:
    """Form lines phrased from orders, with runs of dots, brackets, dashes and blanks of all lengths."""
    return table(spark, d, "orders").select("o_orderkey", T.strip_form_templates(F.expr(_FORM)).alias("text"))


@reg.query(f"select doc_id, case when dev > 0.5 then 'hi' when dev > 0.1 then 'mixed' else 'en' end as script, round(nonascii, 6) as nonascii from (select doc_id, case when {NONSPACE} > 0 then cast(length(regexp_replace(text, '[^\\x{{0900}}-\\x{{097F}}]', '', 'g')) as double) / {NONSPACE} else 0 end as dev, case when {NONSPACE} > 0 then cast(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) as double) / {NONSPACE} else 0 end as nonascii from documents)")
def script_ratio_language(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.script_language(text).alias("script"), F.round(T.share(text, "\\x{80}-\\x{10FFFF}"), 6).alias("nonascii"))


@reg.query(f"select doc_id, round({CONTENT}, 6) as content, case when length(trim(text)) = 0 then false when length(trim(text)) < 5 then true else {CONTENT} < 0.25 and length(text) > 30 end as garbled from documents")
def content_ratio_garbled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(T.content_ratio(F.col("text")), 6).alias("content"), T.is_garbled(F.col("text")).alias("garbled"))


@reg.query("select doc_id, cast(len(string_split(regexp_replace(text, '\\.\\s+', '.' || chr(1), 'g'), chr(1))) as bigint) as sentences from documents")
def sentence_split_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", "(?<=\\.)\\s+")).cast("long").alias("sentences"))


@reg.query(f"select doc_id, round({SCORE}, 4) as score from documents")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(T.quality(F.col("text"))["score"], 4).alias("score"))


AUDIT_DENSITY = DENSITY.replace(T.LEGAL_TERMS, T.AUDIT_LEGAL)
GARBLE = "(" + " + ".join(f"cast(regexp_matches(text, '{q(p)}') as int)" for p in T.AUDIT_GARBLE) + ")"
AUDIT_NOISE = CONTENT.replace("[^\\p{L}]", f"[^{T.AUDIT_NOISE}]")
AUDIT_FORMS = f"len(regexp_extract_all(text, '{q(T.AUDIT_FORM)}'))"


@reg.query(f"select doc_id, round(least(greatest(((100 - least({GARBLE} * 20, 100)) * 0.3 + (case when length(trim(text)) < 50 then length(trim(text)) * 2.0 else 100.0 end) * 0.15 + least({AUDIT_DENSITY} * 500, 100.0) * 0.25 + greatest(0.0, 100.0 - {AUDIT_NOISE} * 200 - {PUNCT} * 100 - {AUDIT_FORMS} * 10) * 0.3) * (case when {GARBLE} > 0 then 0.5 else 1.0 end), 0.0), 100.0), 1) as overall from documents")
def audit_quality_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.sql_audit_score(F.col("text")).alias("overall"))


@reg.query(f"""with x as (select d.doc_id, case when (length(trim(text)) between 1 and 4) or ({CONTENT} < 0.25 and length(text) > 30) then 'garbled' when length(trim(text)) = 0 then 'empty' when {SCORE} < 35 then 'unusable' when l.quality = 0 then 'labelled_bad' else 'kept' end as drop_reason from documents d left join labels l on l.doc_id = d.doc_id)
select drop_reason, count(*) as n from x group by drop_reason""")
def usability_gate(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    scored = table(spark, d, "documents").select("doc_id", T.is_garbled(text).alias("garbled"), (F.length(T.strip(text)) == 0).alias("empty"), T.quality(text)["is_usable"].alias("usable"))
    reason = F.when(F.col("garbled"), "garbled").when(F.col("empty"), "empty").when(~F.col("usable"), "unusable").when(F.col("quality") == 0, "labelled_bad").otherwise("kept")
    return scored.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").groupBy(reason.alias("drop_reason")).agg(F.count("*").alias("n"))


@reg.query("select case when n_chars = 0 then 'empty' when n_chars < 50 then 'short' when n_chars > 5000 then 'oversized' else 'normal' end as bucket, count(*) as n from documents group by 1")
def text_length_buckets(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy(F.when(n == 0, "empty").when(n < 50, "short").when(n > 5000, "oversized").otherwise("normal").alias("bucket")).agg(F.count("*").alias("n"))


@reg.query("select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as target from pages")
def regex_extract_explode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("href=\"([^\"]*)\""), F.lit(1))).alias("target"))


@reg.query("""with x as (select distinct page_id as src, regexp_extract(t, '^/([a-z]+)$', 1) as dst from (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as t from pages))
select dst, count(*) as refs from x where dst <> '' group by dst""")
def link_resolve_dedupe(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "pages").select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit("href=\"([^\"]*)\""), F.lit(1))).alias("t"))
    edges = found.select("src", F.regexp_extract("t", "^/([a-z]+)$", 1).alias("dst")).where("dst <> ''").distinct()
    return edges.groupBy("dst").agg(F.count("*").alias("refs"))


@reg.query("select page_id, cast(len(regexp_extract_all(html, '<li>')) as bigint) as items, cast(len(regexp_extract_all(html, '<p>')) as bigint) as paragraphs from pages")
def html_flatten_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"))


@reg.query("select conv_id, md5(string_agg(text, ' ' order by turn, text)) as digest, count(*) as turns from conversations group by conv_id")
def conversation_fold(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return per.select("conv_id", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), " ")).alias("digest"), F.size("t").cast("long").alias("turns"))


@reg.query("""with m as (select distinct lower(regexp_extract(text, '^([A-Za-z]+) (?:is|the|of)\\b', 1)) as term, conv_id from conversations), f as (select * from m where length(term) > 1 and length(term) < 80)
select term, conv_id from f where not exists (select 1 from benchmark b where starts_with(lower(b.text), f.term || ' '))""")
def definition_mining(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "conversations").select(F.lower(F.regexp_extract("text", "^([A-Za-z]+) (?:is|the|of)\\b", 1)).alias("term"), "conv_id").distinct().where("length(term) > 1 and length(term) < 80")
    known = table(spark, d, "benchmark").select(F.regexp_extract(F.lower("text"), "^([a-z]+) ", 1).alias("term"))
    return found.join(known, "term", "left_anti").select("term", "conv_id")


@reg.query("""with s as (select conv_id, turn, text, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn, text rows unbounded preceding) as section from conversations)
select conv_id, cast(section as bigint) as section, count(*) as turns, cast(sum(length(text)) as bigint) as chars from s group by conv_id, section""")
def state_machine_sections(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(W.unboundedPreceding, 0)
    marked = table(spark, d, "conversations").withColumn("section", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))
    return marked.groupBy("conv_id", "section").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@reg.query("select kind, count(*) as n from (select case when contains(lower(text), 'pour') and contains(lower(text), 'substituted') then 'DECRIMINALIZES' when regexp_matches(text, '(?i)\\bstatt') then 'SUBSTITUTES' when regexp_matches(text, '(?i)with\\s+the') then 'INSERTS' when regexp_matches(text, '(?i)of\\s+the') then 'OMITS' else 'NONE' end as kind from documents) group by kind")
def amendment_classify(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    kind = F.when(F.lower(text).contains("pour") & F.lower(text).contains("substituted"), "DECRIMINALIZES").when(text.rlike("(?i)\\bstatt"), "SUBSTITUTES").when(text.rlike("(?i)with\\s+the"), "INSERTS").when(text.rlike("(?i)of\\s+the"), "OMITS").otherwise("NONE")
    return table(spark, d, "documents").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


QUERY = ("ersh", "nicht", "the", "tionnd", "étion")


@reg.query(f"""with t as (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as t from documents),
s as (select count(*) as n, avg(len(t)) as avgdl from t), w as (select unnest({list(QUERY)!r}) as term),
tf as (select doc_id, len(t) as dl, term, len(list_filter(t, lambda x: x = term)) as tf from t, w),
df as (select term, count(*) filter (where tf > 0) as df from tf group by term)
select doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score
from tf join df using (term), s group by doc_id having sum(tf) > 0 order by score desc, doc_id limit 15""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(table(spark, d, "documents"), "doc_id", "text", QUERY)


@reg.query("with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as term from documents) select term, count(distinct doc_id) as df, count(*) as tf from t group by term")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), "text")
    per = search.postings(docs, ["text"])
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))  # a posting a document


@reg.query("with w as (select distinct unnest(string_split(p_name, ' ')) as w from part) select a.w as a, b.w as b, cast(levenshtein(a.w, b.w) as int) as dist from w a, w b where a.w < b.w and levenshtein(a.w, b.w) <= 2")
def fuzzy_terms(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("a")).distinct()
    return search.fuzzy_pairs(words, words.withColumnRenamed("a", "b"), "a", "b").where("a < b")


_VALUES = ", ".join(f"('{w}')" for w in LEGAL_VOCABULARY)


@reg.query(f"""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from conversations), v as (select * from (values {_VALUES}) t(correct)),
x as (select word, correct, cast(levenshtein(word, correct) as int) as dist from w, v where length(word) >= 4 and abs(length(word) - length(correct)) <= 2 and word not in (select correct from v)),
r as (select *, row_number() over (partition by word order by dist, correct) as rn from x where dist <= 2)
select word, correct, dist from r where rn = 1""")
def spell_correct(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    return search.corrections(words)


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@reg.query(f"select item_id, array_to_string(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 2 and not list_contains([{_STOP}], w)), lambda w: case when length(w) >= 4 then w || '~' else w end), ' ') as terms from benchmark")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.search_terms(F.col("text")).alias("terms"))


def _any(patterns: list[str]) -> str:
    return q(T.any_of(patterns))


_ASKED = "case o_orderkey % 6 when 0 then concat('How was section ', o_orderkey, ' amended?') when 1 then concat('What is the penalty under section ', o_orderkey) when 2 then concat('Which rules refer to section ', o_orderkey) when 3 then concat('How many sections has part ', o_custkey) when 4 then concat('Is there a penalty for order ', o_orderkey) else concat('Show clause ', o_orderkey) end"


@reg.query(f"select o_orderpriority, intent, count(*) as n from (select o_orderpriority, case when regexp_matches(text, '{_any(T.AMENDMENT)}') then 'amendment_query' when regexp_matches(text, '{q(T.SECTION_MENTION)}') and regexp_matches(text, '{_any(T.PENALTY)}') then 'penalty_query' when regexp_matches(text, '{_any(T.CROSS_REFERENCE)}') then 'cross_reference' when regexp_matches(text, '{_any(T.GENERAL_INFO)}') then 'general_info' else 'structured_lookup' end as intent from (select o_orderpriority, {_ASKED} as text from orders)) group by o_orderpriority, intent")
def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    """Questions of all kinds, phrased from orders."""
    asked = table(spark, d, "orders").select("o_orderpriority", T.intent(F.expr(_ASKED)).alias("intent"))
    return asked.groupBy("o_orderpriority", "intent").agg(F.count("*").alias("n"))


_ANSWER = "concat('See [sec-', conv_id, '] and [', role, '-', turn, '], again [sec-', conv_id, '], [', turn, '] and [Not this].')"


@reg.query(f"select conv_id, turn, unnest(list_distinct(regexp_extract_all({_ANSWER}, '\\[([a-z][\\w-]*)\\]', 1))) as citation from conversations")
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    """Citations of answers phrased from conversations: repeated ones, and brackets that are none."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.explode(T.citations(F.expr(_ANSWER))).alias("citation"))


@reg.query(f"select lang, count(*) as nodes, count(*) filter (where {SCORE} >= 35) as usable, round(avg({SCORE}), 3) as mean_score from documents group by lang")
def node_quality_report(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "documents").select("lang", T.quality(F.col("text"))["score"].alias("s"))
    return scored.groupBy("lang").agg(F.count("*").alias("nodes"), F.count_if(F.col("s") >= 35).alias("usable"), F.round(F.avg("s"), 3).alias("mean_score"))


@reg.query(f"select item_id, regexp_matches(regexp_replace(text, '''[^'']*''|\"[^\"]*\"', '''''', 'g'), '(?i)\\b({'|'.join(T.WRITE_WORDS)})\\b') as rejected from benchmark")
def readonly_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.is_write(F.col("text")).alias("rejected"))
