"""Queries that rank: channels, fusion, re-ranking, packing and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context, evaluation, retrieval as rt
from ..session import table
from . import domain as d
from .registry import query

def substring_sql(terms: str, p: str = "") -> str:
    """CTEs that end in {p}r (query_id, ref_id, score, rk), from a CTE of (query_id, term) and the fields f."""
    return f"""{p}t AS (SELECT DISTINCT term FROM {terms}),
{p}h AS (SELECT term, ref_id, 5.0*contains(f0,term)::INT+3.0*contains(f1,term)::INT+1.0*contains(f2,term)::INT boost FROM {p}t, f WHERE contains(f0,term) OR contains(f1,term) OR contains(f2,term)),
{p}df AS (SELECT term, count(*) df FROM {p}h GROUP BY 1),
{p}s AS (SELECT query_id, ref_id, round(sum(ln(1.0+((SELECT count(*) FROM documents)+1.0)/(df+1.0))*least(length(term),6)*boost),6)::DOUBLE score FROM {terms} JOIN {p}h USING (term) JOIN {p}df USING (term) GROUP BY ALL),
{p}r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) rk FROM {p}s)"""


SUBSTRING = f"""q AS (SELECT item_id query_id, unnest(list_distinct(regexp_extract_all(lower(text[1:2048]),'[a-z0-9._-]{{2,}}'))) term FROM benchmark),
f AS (SELECT doc_id::VARCHAR ref_id, source, lower(source) f0, lower(lang) f1, lower(text) f2 FROM documents), {substring_sql('q')}"""


def occ(field: str) -> str:
    """Overlapping occurrences of term: it overlaps itself only where one of its extensions ext by itself stands."""
    return f"CASE WHEN len(ext)>0 AND len(list_filter(ext, lambda x: contains({field},x)))>0 THEN len(list_filter(range(1, length({field})-length(term)+2), lambda i: {field}[i:i+length(term)-1]=term)) ELSE (length({field})-length(replace({field},term,'')))//length(term) END"


def bm25_sql(terms: str, p: str = "b") -> str:
    """CTEs that end in {p}r (query_id, ref_id, score, rk), from a CTE of (query_id, term) and the fields f of SUBSTRING."""
    return f"""{p}q AS (SELECT query_id, term FROM {terms} WHERE length(term)>=3), {p}t AS (SELECT term, list_transform(list_filter(range(1,length(term)), lambda k: left(term,k)=right(term,k)), lambda k: term||substr(term,k+1)) ext FROM (SELECT DISTINCT term FROM {p}q)),
{p}f AS (SELECT *, greatest(length(f0)-2,0)+greatest(length(f1)-2,0)+greatest(length(f2)-2,0) dl FROM f),
{p}h AS (SELECT term, ref_id, dl, 8.0*({occ("f0")})+4.0*({occ("f1")})+1.0*({occ("f2")}) fr FROM {p}t, {p}f WHERE contains(f0,term) OR contains(f1,term) OR contains(f2,term)),
{p}w AS (SELECT term, CASE WHEN raw>0 THEN raw ELSE 1e-6 END idf FROM (SELECT term, ln(((SELECT count(*) FROM f)-count(*)+0.5)/(count(*)+0.5)) raw FROM {p}h GROUP BY 1)),
{p}s AS (SELECT query_id, ref_id, round(sum(idf*fr*2.2/(fr+1.2*(0.25+0.75*dl/(SELECT avg(dl) FROM {p}f)))),6)::DOUBLE score FROM {p}q JOIN {p}h USING (term) JOIN {p}w USING (term) GROUP BY ALL),
{p}r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) rk FROM {p}s)"""


def fused_sql(*channels: tuple[str, str]) -> str:
    """CTE u (query_id, ref_id, fused, channel_best, reasons) of ranked CTEs and their labels."""
    every = " UNION ALL ".join(f"SELECT query_id, ref_id, score, rk, '{label}' label FROM {c} WHERE rk<=80" for c, label in channels)
    return f"u AS (SELECT query_id, ref_id, round(sum(1.0::DOUBLE/(60+rk)),8) fused, max(score) channel_best, array_to_string(list_sort(list(label)),',') reasons FROM ({every}) GROUP BY ALL)"


#: Query and title bonus, final order and limit of a fused CTE u.
FINAL = """y AS (SELECT u.*, source title, round(fused+CASE WHEN lower(trim(text))=f0 THEN 0.03 WHEN trim(text)<>'' AND (contains(f0,lower(trim(text))) OR contains(lower(trim(text)),f0)) THEN 0.015 ELSE 0.0 END,8) score FROM u JOIN f USING (ref_id) JOIN benchmark ON item_id=query_id),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title, ref_id)::INT AS position FROM y)"""


def substring(spark: SparkSession, sf: str, most: int | None = rt.CUT) -> DataFrame:
    return rt.substring_channel(d.records(spark, sf), rt.query_terms(d.queries(spark, sf), tx.lexical_terms(F.col("query"))), most=most)


@query("str04_substring", f"WITH {SUBSTRING} SELECT query_id, ref_id, score FROM s")
def str04(spark: SparkSession, sf: str) -> DataFrame:
    return substring(spark, sf, None).select("query_id", "ref_id", "score")


@query("win01_channel_rank", f"WITH {SUBSTRING} SELECT query_id, ref_id, rk::INT AS rank FROM r WHERE rk<=80")
def win01(spark: SparkSession, sf: str) -> DataFrame:
    return rt.ranked(substring(spark, sf)).select("query_id", "ref_id", "rank")


def bm25(spark: SparkSession, sf: str) -> DataFrame:
    return rt.bm25_channel(d.records(spark, sf), rt.query_terms(d.queries(spark, sf), tx.index_terms(tx.lexical_terms(F.col("query")))), most=rt.CUT)


BOTH = f"{SUBSTRING}, {bm25_sql('q')}"


@query("agg08_rrf", f"WITH {BOTH}, {fused_sql(('r', 'substring'), ('br', 'bm25'))} SELECT query_id, ref_id, fused, channel_best, reasons FROM u")
def agg08(spark: SparkSession, sf: str) -> DataFrame:
    """Both lexical channels, fused."""
    return rt.fuse([substring(spark, sf), bm25(spark, sf)]).select("query_id", "ref_id", "fused", "channel_best", F.array_join("reasons", ",").alias("reasons"))


@query("agg09_session", f"""WITH {SUBSTRING}, u AS (SELECT query_id, ref_id, round(1.0/(60+rk),8)::DOUBLE x, source FROM r JOIN f USING (ref_id) WHERE rk<=80), g AS (SELECT query_id, source, round(sum(x),8) v FROM u GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, source) p FROM g) SELECT query_id, ref_id, source AS session, p::INT session_rank, round(x+1.0/(30+p),8)::DOUBLE fused FROM u JOIN k USING (query_id, source)""")
def agg09(spark: SparkSession, sf: str) -> DataFrame:
    tagged = d.records(spark, sf).select("record_type", "ref_id", "session")
    return rt.session_scores(rt.fuse([substring(spark, sf)]), tagged).select("query_id", "ref_id", "session", "session_rank", F.round("fused", 8).alias("fused"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("ref_id"), "text")
    return docs.join(F.broadcast(d.queries(spark, sf)), F.col("text").contains(F.col("query"))).groupBy("query_id").agg(F.collect_set("ref_id").alias("gold"))


def scored(spark: SparkSession, sf: str, hits: DataFrame) -> DataFrame:
    """Hits (query_id, ref_id, position): the first five retrieved, the first three of them retained."""
    none = F.array().cast("array<string>")
    got = hits.groupBy("query_id").agg(F.collect_set(F.when(F.col("position") <= 5, F.col("ref_id"))).alias("retrieved"), F.collect_set(F.when(F.col("position") <= 3, F.col("ref_id"))).alias("retained"))
    rows = d.queries(spark, sf).join(got, "query_id", "left").join(gold(spark, sf), "query_id", "left")
    rows = rows.select("query_id", *[F.coalesce(c, none).alias(c) for c in ("gold", "retrieved", "retained")], none.alias("forbidden"), none.alias("foreign"))
    return evaluation.score_evidence(rows)


EVIDENCE = f"""WITH {SUBSTRING}, g AS (SELECT item_id query_id, doc_id::VARCHAR ref_id FROM benchmark b, documents x WHERE contains(x.text, b.text)),
e AS (SELECT item_id query_id, (SELECT count(*) FROM g WHERE g.query_id=item_id) ng, (SELECT count(*) FROM g JOIN r USING (query_id, ref_id) WHERE g.query_id=item_id AND rk<=3) n3, (SELECT count(*) FROM g JOIN r USING (query_id, ref_id) WHERE g.query_id=item_id AND rk<=5) n5, (SELECT count(*) FROM r WHERE r.query_id=item_id AND rk<=3) m FROM benchmark),
c AS (SELECT query_id, ng>0 answerable, CASE WHEN ng>0 THEN n3/ng END evidence_recall, CASE WHEN ng>0 THEN n5/ng END retrieval_recall, ng>0 AND n3=ng full_coverage, ng=0 AND m>0 false_retrieval, n5>n3 AS dropped, ng>0 AND n3=0 missed, n3>0 AND n3<ng part FROM e)"""


@query("agg12_evidence", f"{EVIDENCE} SELECT query_id, answerable, round(evidence_recall,6) evidence_recall, round(retrieval_recall,6) retrieval_recall, full_coverage, false_retrieval, concat_ws(',', CASE WHEN dropped THEN 'context_budget_drop' END, CASE WHEN part THEN 'incomplete_evidence' END, CASE WHEN missed THEN 'recall_miss' END, CASE WHEN false_retrieval THEN 'unanswerable_false_retrieval' END) failures FROM c")
def agg12(spark: SparkSession, sf: str) -> DataFrame:
    s = scored(spark, sf, rt.ranked(substring(spark, sf)).withColumnRenamed("rank", "position"))
    return s.select("query_id", "answerable", F.round("evidence_recall", 6).alias("evidence_recall"), F.round("retrieval_recall", 6).alias("retrieval_recall"), "full_coverage", "false_retrieval", F.array_join("failures", ",").alias("failures"))


@query("agg13_macro", f"{EVIDENCE} SELECT count(*) questions, count(*) FILTER (answerable) answerable, count(*) FILTER (NOT answerable) unanswerable, round(avg(evidence_recall),6) evidence_recall_macro, round(avg(retrieval_recall),6) retrieval_recall_macro, round(avg(full_coverage::INT) FILTER (answerable),6) full_coverage_rate, round(avg(false_retrieval::INT) FILTER (NOT answerable),6) false_retrieval_rate FROM c")
def agg13(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.macro(scored(spark, sf, rt.ranked(substring(spark, sf)).withColumnRenamed("rank", "position")))


@query("agg22_bm25", f"WITH {BOTH} SELECT query_id, ref_id, score, rk::INT AS rank FROM br WHERE rk<=80")
def agg22(spark: SparkSession, sf: str) -> DataFrame:
    return rt.ranked(bm25(spark, sf)).select("query_id", "ref_id", "score", "rank")


def search(spark: SparkSession, sf: str, limit: int = 6) -> DataFrame:
    return rt.search(d.queries(spark, sf), d.records(spark, sf), limit=limit)


@query("ret01_search", f"WITH {BOTH}, {fused_sql(('r', 'substring'), ('br', 'bm25'))}, {FINAL} SELECT query_id, position, 'event' record_type, ref_id, title, score, reasons FROM z WHERE position<=6")
def ret01(spark: SparkSession, sf: str) -> DataFrame:
    return search(spark, sf).select("query_id", "position", "record_type", "ref_id", "title", "score", F.array_join("reasons", ",").alias("reasons"))


@query("ret11_benchmark")
def ret11(spark: SparkSession, sf: str) -> DataFrame:
    """Acceptance figures of the search over all benchmark queries."""
    return evaluation.macro(scored(spark, sf, search(spark, sf)))


@query("ret07_pack")
def ret07(spark: SparkSession, sf: str) -> DataFrame:
    hits = search(spark, sf).select("query_id", "query", "project_id", "position", "record_type", "ref_id", "title", "body")
    return context.pack(hits)


@query("top10_pack_whole")
def top10(spark: SparkSession, sf: str) -> DataFrame:
    hits = search(spark, sf).select("query_id", F.col("ref_id").alias("source_id"), F.col("position").cast("long").alias("position"), F.octet_length("body").cast("long").alias("n_bytes"), F.octet_length("query").cast("long").alias("header_bytes"))
    return context.pack_whole(hits, 4000)


@query("top08_coverage")
def top08(spark: SparkSession, sf: str) -> DataFrame:
    recs = d.records(spark, sf)
    return rt.coverage(search(spark, sf, 16), d.queries(spark, sf), recs)


@query("str09_idf", "SELECT count(*) tokens, max(df) max_df, round(sum(ln(1.0+(n+1.0)/(df+1.0))),3) mass FROM (SELECT t, count(*) df FROM (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(regexp_extract_all(lower(source||chr(10)||lang||chr(10)||text),'[a-z0-9][a-z0-9._-]*')) t FROM documents) WHERE length(t)>=2 AND t NOT IN (" + ",".join(f"'{w}'" for w in tx.COVERAGE_STOPWORDS) + ")) GROUP BY 1), (SELECT count(*) n FROM documents)")
def str09_idf(spark: SparkSession, sf: str) -> DataFrame:
    return rt.token_idf(d.records(spark, sf)).agg(F.count("*").alias("tokens"), F.max("df").alias("max_df"), F.round(F.sum("idf"), 3).alias("mass"))


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors as records; every row whose id is divisible by 50 as a query."""
    e = table(spark, sf, "embeddings")
    unit = F.transform(F.col("embedding").cast("array<double>"), lambda x: x / F.sqrt(tx.dot(F.col("embedding"), F.col("embedding"))))
    recs = e.select(F.lit("event").alias("record_type"), F.col("vec_id").cast("string").alias("ref_id"), unit.alias("vector"))
    return recs, recs.where(F.col("ref_id").cast("long") % 50 == 0).select(F.col("ref_id").cast("long").alias("query_id"), "vector")


@query("joi11_similarity", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), s AS (SELECT q.vec_id query_id, x.vec_id::VARCHAR ref_id, round(list_dot_product(q.v,x.v)/(sqrt(list_dot_product(q.v,q.v))*sqrt(list_dot_product(x.v,x.v))),6) score FROM e q, e x WHERE q.vec_id%50=0)
SELECT query_id, ref_id, score, p::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) p FROM s WHERE score>=0.08) WHERE p<=80""")
def joi11(spark: SparkSession, sf: str) -> DataFrame:
    recs, qs = vectors(spark, sf)
    return rt.ranked(rt.vector_channel(recs, qs)).select("query_id", "ref_id", "score", "rank")


@query("top07_mmr")
def top07(spark: SparkSession, sf: str) -> DataFrame:
    recs, qs = vectors(spark, sf)
    hits = rt.ranked(rt.vector_channel(recs, qs)).withColumnRenamed("rank", "position").join(recs, ["record_type", "ref_id"])
    return rt.mmr(hits.withColumn("position", F.col("position").cast("long")))


@query("win02_session_views", """SELECT conv_id AS session, turn AS position, string_agg(b, chr(10) ORDER BY o) AS "view" FROM (SELECT c.conv_id, c.turn, x.turn o, x.text b FROM conversations c JOIN (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) p FROM conversations) y ON y.conv_id=c.conv_id AND y.turn=c.turn JOIN (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) p FROM conversations) x ON x.conv_id=c.conv_id AND x.p BETWEEN y.p-1 AND y.p+1 WHERE trim(x.text, chr(32)||chr(9)||chr(10)||chr(13))<>'') GROUP BY ALL""")
def win02(spark: SparkSession, sf: str) -> DataFrame:
    return rt.session_views(d.messages(spark, sf)).where("view <> ''").select("session", "position", "view")


@query("agg21_term_cosine", """WITH qf AS (SELECT item_id, regexp_replace(lower(text),'\\s+','','g') c, regexp_extract_all(lower(text),'[a-z0-9._-]{2,}') w FROM benchmark), sf AS (SELECT doc_id, regexp_replace(lower(text),'\\s+','','g') c, regexp_extract_all(lower(text),'[a-z0-9._-]{2,}') w FROM documents),
sc AS (SELECT doc_id, ch||lead(ch) OVER (PARTITION BY doc_id ORDER BY i) t FROM (SELECT doc_id, unnest(string_split(c,'')) ch, generate_subscripts(string_split(c,''),1) i FROM sf)),
s AS (SELECT doc_id, t, count(*) c FROM (SELECT doc_id, t FROM sc WHERE t IS NOT NULL UNION ALL SELECT doc_id, unnest(w) FROM sf) GROUP BY ALL),
q AS (SELECT item_id, t, count(*) c FROM (SELECT item_id, unnest([c[i:i+1] for i in range(1,length(c))]) t FROM qf UNION ALL SELECT item_id, unnest(w) FROM qf) GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(c*c)) n FROM s GROUP BY 1), m AS (SELECT item_id, sqrt(sum(c*c)) m FROM q GROUP BY 1),
x AS (SELECT item_id query_id, doc_id::VARCHAR source_id, round(sum(q.c*s.c)/(any_value(n)*any_value(m)),6) score FROM q JOIN s USING (t) JOIN n USING (doc_id) JOIN m USING (item_id) GROUP BY ALL)
SELECT query_id, source_id, score, p::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) p FROM x) WHERE p<=5""")
def agg21(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("body"))
    return rt.term_cosine(d.queries(spark, sf), docs)


@query("win09_window", """WITH h AS (SELECT o_custkey q, o_orderkey::VARCHAR r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS p FROM orders), x AS (SELECT *, p e FROM h WHERE p>8), d AS (SELECT * FROM h WHERE p<=8),
i AS (SELECT q, r, row_number() OVER (PARTITION BY q ORDER BY p) e FROM x), t AS (SELECT q, count(*) k FROM i WHERE e<=2 GROUP BY 1),
s AS (SELECT d.q, d.r, 0 a, d.p o FROM d LEFT JOIN t USING (q) WHERE d.p<=greatest(0,8-coalesce(k,0)) UNION ALL SELECT q, r, CASE WHEN e<=2 THEN 1 ELSE 2 END, e FROM i)
SELECT q query_id, r ref_id, row_number() OVER (PARTITION BY q ORDER BY a, o)::INT slot FROM s""")
def win09(spark: SparkSession, sf: str) -> DataFrame:
    """A window of eight with two reserved slots: a customer's dearest orders, then the others."""
    w = Window.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.lit("event").alias("record_type"), F.col("o_orderkey").cast("string").alias("ref_id"), "o_totalprice", "o_orderkey").withColumn("position", F.row_number().over(w))
    return rt.compose(o.where("position <= 8"), o.where("position > 8"), 8, ["position"]).select("query_id", "ref_id", "slot")


@query("ret02_legacy", f"WITH {SUBSTRING}, c AS (SELECT item_id query_id, unnest(regexp_extract_all(lower(text),'[a-z0-9._-]{{3,}}')[1:12]) term FROM benchmark), {bm25_sql('c')}, {fused_sql(('br', 'bm25'))}, {FINAL} SELECT query_id, position, ref_id, score FROM z WHERE position<=6")
def ret02(spark: SparkSession, sf: str) -> DataFrame:
    return rt.search_legacy(d.queries(spark, sf), d.records(spark, sf)).select("query_id", "position", "ref_id", "score")


EXPANDED = "x AS (SELECT item_id query_id, unnest(list_distinct(regexp_extract_all(lower(('I remember discussing: '||trim(regexp_replace(text,'\\s+',' ','g')))[1:2048]),'[a-z0-9._-]{2,}'))) term FROM benchmark)"


@query("ret04_expansions", f"WITH {SUBSTRING}, {EXPANDED}, {bm25_sql('x')}, {substring_sql('x', 'e')}, {fused_sql(('r', 'substring'), ('br', 'expansion-bm25'), ('er', 'expansion-substring'))} SELECT query_id, ref_id, fused, reasons FROM u")
def ret04(spark: SparkSession, sf: str) -> DataFrame:
    """The recall template as an expansion of each query, fused with the query's own channel."""
    qs, recs = d.queries(spark, sf), d.records(spark, sf)
    extra = qs.select("query_id", tx.recall_template(F.col("query")).alias("expansion"))
    terms = rt.query_terms(qs, tx.lexical_terms(F.col("query")))
    hits = rt.lexical_hits(recs, terms.union(rt.expansion_terms(extra)))
    own = rt.substring_channel(recs, terms, hits, rt.CUT)
    return rt.fuse([own, *rt.expansions(qs, extra, recs, hits, rt.CUT)]).select("query_id", "ref_id", "fused", F.array_join("reasons", ",").alias("reasons"))


@query("ret06_session_views")
def ret06(spark: SparkSession, sf: str) -> DataFrame:
    terms = rt.query_terms(d.queries(spark, sf), tx.lexical_terms(F.col("query")))
    return rt.ranked(rt.session_view_channel(d.messages(spark, sf), terms, rt.CUT)).select("query_id", "ref_id", "score", "rank")


@query("pas08_search")
def pas08(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import passages

    return passages.search(d.queries(spark, sf), d.records(spark, sf))


@query("win05_per_parent", "WITH a AS (SELECT event_type, user_id, event_id, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) n FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) r FROM a WHERE n<=2) SELECT event_type query_id, user_id parent_id, event_id passage_id, r::INT AS rank FROM b WHERE r<=160")
def win05(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.passages import per_parent

    rows = table(spark, sf, "events").select(F.col("event_type").alias("query_id"), F.col("user_id").alias("parent_id"), F.col("event_id").alias("passage_id"), F.col("value").alias("score"))
    return per_parent(rows).select("query_id", "parent_id", "passage_id", "rank")


@query("top11_near_duplicates", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] v FROM embeddings), s AS (SELECT p.vec_id probe_id, f.vec_id fact_id, round(list_dot_product(p.v,f.v),6) similarity FROM e p JOIN e f ON p.label=f.label AND p.vec_id<>f.vec_id WHERE p.vec_id%50=0)
SELECT probe_id, fact_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY similarity DESC, fact_id) n FROM s WHERE similarity>=0.1) WHERE n=1""")
def top11(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.memory import near_duplicates

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), F.col("embedding").alias("vector"))
    return near_duplicates(e.where(F.col("id") % 50 == 0), e, 0.1)


@query("joi06_aliases", r"""WITH a AS (SELECT lower(regexp_extract(text,'[A-Za-z]+')) alias, min('item-'||item_id) canonical FROM benchmark GROUP BY 1), m AS (SELECT b.item_id, canonical FROM benchmark b JOIN a ON alias<>'' AND regexp_matches(lower(b.text), '(^|[^\pL\pM\pN_])'||alias||'($|[^\pL\pM\pN_])') AND NOT contains(lower(b.text), canonical))
SELECT item_id query_id, array_to_string(list_sort(list(DISTINCT canonical))[1:12], ',') added FROM m GROUP BY 1""")
def joi06(spark: SparkSession, sf: str) -> DataFrame:
    """The first word of each passage as an alias of it."""
    b = table(spark, sf, "benchmark")
    al = b.select(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("alias"), F.concat(F.lit("item-"), "item_id").alias("c")).groupBy("alias").agg(F.min("c").alias("canonical_name")).where("alias <> ''")
    return rt.alias_expand(d.queries(spark, sf), al).where("added IS NOT NULL").select("query_id", F.array_join("added", ",").alias("added"))
