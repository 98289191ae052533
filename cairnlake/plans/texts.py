"""Queries on texts and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import temporal as tm
from ..functions import text as tx
from ..operators import passages, reports
from ..session import table
from . import domain as d
from .registry import query

WORDS = "[a-z0-9._-]{2,}"


@query("str01_terms", f"SELECT query_id, string_agg(term, ' ' ORDER BY i) terms FROM (SELECT query_id, term, min(i) i FROM (SELECT item_id query_id, unnest(w) term, generate_subscripts(w,1) i FROM (SELECT item_id, regexp_extract_all(lower(text[1:2048]),'{WORDS}') w FROM benchmark)) GROUP BY ALL) GROUP BY 1")
def str01(spark: SparkSession, sf: str) -> DataFrame:
    return d.queries(spark, sf).select("query_id", F.array_join(tx.lexical_terms(F.col("query")), " ").alias("terms"))


@query("str03_legacy_terms", "SELECT item_id query_id, array_to_string(regexp_extract_all(lower(text),'[A-Za-z0-9._-]{3,}')[1:12],' ') terms FROM benchmark")
def str03(spark: SparkSession, sf: str) -> DataFrame:
    return d.queries(spark, sf).select("query_id", F.array_join(tx.legacy_terms(F.col("query")), " ").alias("terms"))


@query("str05_features", f"SELECT doc_id, (greatest(n-1,0)+greatest(n-2,0)+len(regexp_extract_all(trim(regexp_replace(lower(text),'\\s+',' ','g')),'{WORDS}')))::INT n_features FROM (SELECT doc_id, text, length(regexp_replace(lower(text),'\\s+','','g')) n FROM documents)")
def str05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(tx.features(F.col("text"))).alias("n_features"))


@query("str06_vectors")
def str06(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.hashed_vector(F.col("text")).alias("vector"))


@query("str07_md5_vectors", f"""WITH b AS (SELECT item_id, trim(regexp_replace(lower(text),'\\s+',' ','g')) p, regexp_replace(lower(text),'\\s+','','g') c FROM benchmark),
f AS (SELECT item_id, unnest([c[i:i+1] for i in range(1,length(c))]) f FROM b UNION ALL SELECT item_id, unnest([c[i:i+2] for i in range(1,length(c)-1)]) FROM b UNION ALL SELECT item_id, 'w:'||unnest(regexp_extract_all(p,'{WORDS}')) FROM b),
h AS (SELECT item_id, ('0x'||substr(md5(f),1,15))::BIGINT h FROM f)
SELECT item_id, (h%512)::INT bucket, sum(CASE WHEN (h>>59)=1 THEN -1 ELSE 1 END)::BIGINT weight FROM h GROUP BY ALL""")
def str07(spark: SparkSession, sf: str) -> DataFrame:
    """The vector's recipe with md5 in place of BLAKE2b, which SQL lacks: a variant for the check, not the vector itself."""
    rows = table(spark, sf, "benchmark").select("item_id", F.explode(tx.features(F.col("text"))).alias("f"))
    return rows.select("item_id", tx.md5_bucket(F.col("f")).alias("h")).groupBy("item_id", "h.bucket").agg(F.sum("h.sign").alias("weight"))


@query("str09_coverage_tokens", "SELECT item_id, string_agg(t,' ' ORDER BY t) tokens FROM (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_extract_all(lower(text),'[a-z0-9][a-z0-9._-]*')) t FROM benchmark) WHERE length(t)>=2 AND t NOT IN (" + ",".join(f"'{w}'" for w in tx.COVERAGE_STOPWORDS) + ")) GROUP BY 1")
def str09(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.sort_array(tx.coverage_tokens(F.col("text"))), " ").alias("tokens"))


STOPS = "[" + ",".join(f"'{w}'" for w in tx.ENTITY_STOPWORDS) + "]"


@query("str10_entities", f"""WITH r AS (SELECT doc_id, regexp_extract_all(text[1:16000],'[A-Z][A-Za-z]{{2,}}(?:\\s+[A-Z][A-Za-z]{{2,}}){{0,2}}') a FROM documents),
e AS (SELECT doc_id, unnest(a) n, generate_subscripts(a,1) i FROM r), k AS (SELECT * FROM e WHERE len(list_filter(regexp_split_to_array(n,'\\s+'), lambda w: NOT list_contains({STOPS}, w)))>0),
f AS (SELECT doc_id, arg_min(n,i) n, min(i) i FROM k GROUP BY doc_id, lower(n)), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) p FROM f)
SELECT doc_id, string_agg(n,'|' ORDER BY i) entities FROM o WHERE p<=8 GROUP BY 1""")
def str10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.entities(F.col("text")), "|").alias("entities")).where("entities <> ''")


@query("str12_slug", "SELECT page_id, trim(regexp_replace(lower(url),'[^a-z0-9一-鿿._-]+','-','g'),'-') slug FROM pages")
def str12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("str13_session_tag", "SELECT conv_id, turn, 'aml-session:'||substr(sha256(role||chr(0)||conv_id::VARCHAR),1,24) tag FROM conversations")
def str13(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.session_tag(F.col("role"), F.col("conv_id").cast("string")).alias("tag"))


@query("str17_sentences")
def str17(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(tx.sentence_units(F.col("text"))).alias("n_units"))


@query("str18_recall_template", "SELECT item_id query_id, 'I remember discussing: '||substr(trim(regexp_replace(text,'\\s+',' ','g')),1,4000) rewritten FROM benchmark")
def str18(spark: SparkSession, sf: str) -> DataFrame:
    return d.queries(spark, sf).select("query_id", tx.recall_template(F.col("query")).alias("rewritten"))


@query("prj02_record_text", "SELECT doc_id, sha256(source||chr(10)||lang||chr(10)||text) text_sha256 FROM documents")
def prj02(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.array(F.col("lang"), F.lit("aml-session:0"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.record_text(F.col("source"), tags, F.col("text")), 256).alias("text_sha256"))


def any_match(col: str, patterns: list[str]) -> str:
    return " OR ".join(f"regexp_matches({col}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns)


@query("fil11_secrets", f"SELECT doc_id FROM documents WHERE {any_match('text', tx.SECRETS)}")
def fil11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(tx.has_secret(F.col("text"))).select("doc_id")


@query("fil12_high_risk", f"SELECT doc_id FROM documents WHERE {any_match('text', [tx.HIGH_RISK])}")
def fil12(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(tx.high_risk(F.col("text"))).select("doc_id")


@query("agg19_keywords", "SELECT doc_id, score FROM (SELECT doc_id, ((length(b)-length(replace(b,'the','')))//3 + (length(b)-length(replace(b,'und','')))//3)::BIGINT score FROM (SELECT doc_id, lower(text[1:20000]) b FROM documents)) WHERE score>0")
def agg19(spark: SparkSession, sf: str) -> DataFrame:
    return reports.keyword_counts(table(spark, sf, "documents").select("doc_id", F.col("text").alias("body")), ["the", "und"]).select("doc_id", "score")


MONTH_NAMES = "['" + "','".join(tm.MONTHS) + "']"
DAY_NAMES, DAY_NAMES_CN = "['" + "','".join(tm.WEEKDAYS) + "']", "['" + "','".join(tm.WEEKDAYS_CN) + "']"


@query("dat01_time_text", f"""WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) d FROM orders), x AS (SELECT d, datediff('day', d, DATE '2024-02-01') k FROM o)
SELECT strftime(d,'%Y-%m-%d') AS day, concat_ws(' ', strftime(d,'%Y-%m-%d'), year(d)||'年'||month(d)||'月'||day(d)||'日', year(d)||'年'||month(d)||'月', {MONTH_NAMES}[month(d)]||' '||day(d)||', '||year(d), {MONTH_NAMES}[month(d)]||' '||year(d),
 {DAY_NAMES_CN}[isodow(d)], {DAY_NAMES}[isodow(d)], CASE WHEN k=0 THEN '今天 today' END, CASE WHEN k=1 THEN '昨天 yesterday' END, CASE WHEN k=2 THEN '前天' END, CASE WHEN k=-1 THEN '明天 tomorrow' END,
 CASE WHEN k BETWEEN 0 AND 6 THEN '本周 this week' END, CASE WHEN k BETWEEN 7 AND 13 THEN '上周 last week' END, CASE WHEN year(d)=2024 AND month(d)=2 THEN '本月 这个月 this month' END, CASE WHEN year(d)=2024 THEN '今年 this year' END, CASE WHEN year(d)=2023 THEN '去年 last year' END) said FROM x""")
def dat01(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), tm.time_text(F.array("day"), d.NOW).alias("said"))


@query("dat02_recency", "SELECT event_id, round(0.004*pow(0.5, greatest(0, epoch(TIMESTAMP '2024-02-01') - epoch(ts))/2592000.0),9) bonus FROM events")
def dat02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(tm.recency_bonus(F.col("ts"), d.NOW), 9).alias("bonus"))


ASKED = ["as of March 2026", "in 2023-05-04", "before 2020", "during the summer of 2021", "since May 2020", "what did we use previously", "last week", "in 2026-13-45 or in 2023", "截至2026年3月", "2026年3月之前", "winter", "first half of September 2022", "between August and November 2023"]


@query("dat03_intent")
def dat03(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(ASKED)], "query_id long, query string")
    return asked.union(d.queries(spark, sf).select("query_id", "query")).select("query_id", "query", tm.temporal_intent(F.col("query"), d.NOW).alias("i")).select("query_id", "query", "i.*")


SEASON = "CASE WHEN month(o_orderdate) IN (3,4,5) THEN 'spring' WHEN month(o_orderdate) IN (6,7,8) THEN 'summer' WHEN month(o_orderdate) IN (9,10,11) THEN 'fall' ELSE 'winter' END"


@query("dat06_date_tags", f"""SELECT o_orderkey, concat_ws('|', strftime(o_orderdate,'%Y-%m-%d'), strftime(o_orderdate,'%B %-d, %Y'), strftime(o_orderdate,'%B %Y'), {SEASON}||strftime(o_orderdate,' %Y'), CASE WHEN month(o_orderdate) IN (9,10,11) THEN strftime(o_orderdate,'autumn %Y') END, strftime(o_orderdate,'%Y')) tags FROM orders""")
def dat06(spark: SparkSession, sf: str) -> DataFrame:
    """Dates of orders as sentences say them."""
    said = F.concat(F.lit("Ordered on "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("."))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(tm.date_tags(said), "|").alias("tags"))


@query("dat08_from_millis", "SELECT event_id, ts FROM events")
def dat08(spark: SparkSession, sf: str) -> DataFrame:
    """Milliseconds there and back, with the microseconds below them."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    back = F.unix_micros(tm.from_millis(F.floor(us / 1000))) + us % 1000
    return table(spark, sf, "events").select("event_id", F.timestamp_micros(back).cast("timestamp_ntz").alias("ts"))


@query("pas01_passages")
def pas01(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("parent_id"), F.col("text").alias("body"))
    return passages.split(rows).drop("text")


@query("pas01_conversations")
def pas01_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as role-headed bodies; no passage crosses a turn."""
    turn = F.concat(F.col("role"), F.lit(": "), F.col("body"))
    rows = d.messages(spark, sf).groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", turn.alias("t")))), lambda x: x["t"]), "\n").alias("body"))
    return passages.split(rows.select(F.col("session").cast("string").alias("parent_id"), "body")).drop("text")


@query("pas07_expand", """WITH s AS (SELECT doc_id, n_chars::INT n, (doc_id*37 % n_chars)::INT a FROM documents WHERE n_chars>0), t AS (SELECT *, least(n, a+900)::INT e FROM s),
u AS (SELECT *, 1800-(e-a) room, least(120,a) wl, least(120,n-e) wr FROM t), v AS (SELECT *, least(wl,(room+1)//2) l FROM u), w AS (SELECT *, least(wr, room-l) r FROM v)
SELECT doc_id, (a - (l + least(wl-l, room-l-r)))::INT AS start, (e+r)::INT AS "end" FROM w""")
def pas07(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("n_chars > 0").select("doc_id", F.col("n_chars").cast("int").alias("n"), (F.col("doc_id") * 37 % F.col("n_chars")).cast("int").alias("a"))
    start, end = passages.expanded(F.col("a"), F.least(F.col("n"), F.col("a") + 900), F.col("n"))
    return rows.select("doc_id", start.cast("int").alias("start"), end.cast("int").alias("end"))
