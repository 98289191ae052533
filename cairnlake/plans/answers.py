"""Queries of what is built on the search: rewordings, requests, packed contexts, readers' cases, evidence by coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, evaluation, passages, retrieval as rt
from ..session import table
from . import domain as d
from .ranked import search, vectors
from .registry import query

ALIASES = "a AS (SELECT DISTINCT lower(regexp_extract(text,'[A-Za-z]+')) alias, 'item-'||item_id name FROM benchmark)"


@query("joi07_alias_legacy", f"WITH {ALIASES} SELECT item_id query_id, string_agg(name, ',' ORDER BY name) added FROM benchmark JOIN a ON alias<>'' AND contains(lower(text), alias) AND NOT contains(lower(text), name) GROUP BY 1")
def joi07(spark: SparkSession, sf: str) -> DataFrame:
    """The first word of each passage as an alias of it, found anywhere."""
    b = table(spark, sf, "benchmark")
    al = b.select(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)).alias("alias"), F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("canonical_name"))
    return rt.alias_expand_legacy(d.queries(spark, sf), al).where("added IS NOT NULL").select("query_id", F.array_join("added", ",").alias("added"))


SCORES = "e AS (SELECT vec_id, embedding::DOUBLE[] v FROM embeddings), s AS (SELECT q.vec_id query_id, x.vec_id::VARCHAR ref_id, round(list_dot_product(q.v,x.v)/(sqrt(list_dot_product(q.v,q.v))*sqrt(list_dot_product(x.v,x.v))),6) score FROM e q, e x WHERE q.vec_id%50=0)"


@query("top05_legacy_order", f"WITH {SCORES} SELECT query_id, ref_id, score, p::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id DESC) p FROM s WHERE score>=0.08) WHERE p<=80")
def top05(spark: SparkSession, sf: str) -> DataFrame:
    return rt.ranked_legacy(rt.vector_channel(*vectors(spark, sf))).select("query_id", "ref_id", "score", "rank")


@query("ret05_expansion_vectors", f"WITH {SCORES} SELECT query_id//200 query_id, ref_id, max(score) score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) p FROM s WHERE score>0) WHERE p<=80 GROUP BY ALL")
def ret05(spark: SparkSession, sf: str) -> DataFrame:
    """Four neighbouring probes as rewordings of one query; each has its best 80."""
    recs, probes = vectors(spark, sf)
    each = rt.ranked(rt.vector_channel(recs, probes, 0.0, "expansion-vector", inclusive=False))
    return each.withColumn("query_id", F.floor(F.col("query_id") / 200)).groupBy("query_id", "ref_id").agg(F.max("score").alias("score"))


@query("top13_v1_ranking", """WITH w AS (SELECT DISTINCT item_id q, unnest(regexp_extract_all(lower(text),'[\\pL\\pM\\pN_.-]{2,}')) w FROM benchmark WHERE item_id<5), f AS (SELECT doc_id, source||'/'||doc_id AS path, lower(text) t, n_chars c FROM documents WHERE text IS NOT NULL),
s AS (SELECT q, path, any_value(c) c, sum((length(t)-length(replace(t,w,'')))//length(w)) n FROM w JOIN f ON contains(t,w) GROUP BY ALL) SELECT q query_id, path, n::BIGINT score, row_number() OVER (PARTITION BY q ORDER BY n DESC, c DESC, path DESC)::INT AS position FROM s QUALIFY position<=5""")
def top13(spark: SparkSession, sf: str) -> DataFrame:
    """Five passages as queries; whole texts, their size as the time."""
    files = table(spark, sf, "documents").where("text IS NOT NULL").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("text").alias("body"), F.col("n_chars").alias("changed_at"))
    return rt.v1_ranking(d.queries(spark, sf).where("query_id < 5"), files, chars=None).select("query_id", "path", "score", "position")


@query("ret13_requests")
def ret13(spark: SparkSession, sf: str) -> DataFrame:
    """Two options to each question; as many hits as its number says."""
    q = d.queries(spark, sf).select("query_id", "query", F.array(F.lit("yes or no"), F.lit(" ")).alias("options"), F.col("query_id").cast("int").alias("top_k"))
    return rt.requested(q, d.records(spark, sf)).select("query_id", "position", "ref_id", "score")


@query("ctx01_hits")
def ctx01(spark: SparkSession, sf: str) -> DataFrame:
    """Every second question without words, which gives the startup context of its project."""
    q = d.queries(spark, sf).withColumn("project_id", F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es", "none")]), (F.col("query_id") % 5 + 1).cast("int")))
    q = q.withColumn("query", F.when(F.col("query_id") % 2 == 0, " ").otherwise(F.col("query")))
    recs = d.records(spark, sf).withColumn("valid_from", F.col("ref_id").cast("long"))
    return context.context_hits(q, recs).select("query_id", "project_id", "ref_id", "position")


@query("ctx02_render")
def ctx02(spark: SparkSession, sf: str) -> DataFrame:
    hits = search(spark, sf).select("query_id", "query", "project_id", "position", "record_type", "ref_id", "title", "body")
    return context.render(hits, [("RULES.md", "Be brief."), ("MORE.md", "long " * 2000)], 4000)[0]


@query("ret09_pack_passages")
def ret09(spark: SparkSession, sf: str) -> DataFrame:
    recs, qs = d.records(spark, sf), d.queries(spark, sf)
    found = passages.search(qs, recs).select("query_id", F.col("parent_id").alias("ref_id"), "position", "spans")
    texts = rt.with_records(found, recs.select("record_type", "ref_id", "title", "body", "project_id"), ["ref_id"])
    return context.pack_passages(texts.join(qs, "query_id"), 3000, fallback=True)


@query("eva02_cases")
def eva02(spark: SparkSession, sf: str) -> DataFrame:
    hits = search(spark, sf).select(F.col("query_id").cast("string").alias("question_id"), F.lit("lexical").alias("baseline"), F.col("query").alias("question"), "position", F.col("ref_id").alias("source_id"), "title", "body")
    return evaluation.reader_cases(hits, 4000, "excerpt").select("question_id", "source_ids", "complete_source_ids", "n_bytes")


@query("pas06_neighbors", """WITH p AS (SELECT doc_id, g FROM (SELECT doc_id, unnest(range(0, n_chars//100)) g FROM documents WHERE n_chars>=100)), t AS (SELECT doc_id, max(g)//2 m FROM p GROUP BY 1)
SELECT doc_id::VARCHAR parent_id, g::VARCHAR passage_id FROM p JOIN t USING (doc_id) WHERE abs(g-m)<=2 AND NOT (g=m+2 AND m>=2)""")
def pas06(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of a hundred characters; the middle one with its neighbours, four of them at most."""
    docs = table(spark, sf, "documents").where("n_chars >= 100")
    rows = docs.select(F.col("doc_id").cast("string").alias("parent_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 100) - 1)).alias("g"))
    parts = rows.select("parent_id", F.col("g").cast("string").alias("passage_id"), (F.col("g") * 100).alias("start"), (F.col("g") * 100 + 100).alias("end"))
    middle = rows.groupBy("parent_id").agg(F.floor(F.max("g") / 2).cast("string").alias("passage_id"))
    return passages.neighbors_within(parts, middle, 2, 400).select("parent_id", "passage_id")


@query("pas12_located", "SELECT doc_id request_id, doc_id::VARCHAR parent_id, 0::INT AS start, least(180, length(text))::INT AS \"end\", text[1:least(180, length(text))] AS text FROM documents WHERE length(text)>=60 AND doc_id%3<>0")
def pas12(spark: SparkSession, sf: str) -> DataFrame:
    """Characters 10 to 60 of each text with their surroundings; a third of the requests name another digest."""
    docs = table(spark, sf, "documents")
    sha = F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.sha2("text", 256))
    asked = docs.select(F.col("doc_id").alias("request_id"), F.col("doc_id").cast("string").alias("parent_id"), sha.alias("body_sha256"), F.lit(10).alias("start"), F.lit(60).alias("end"))
    return passages.located(asked, d.records(spark, sf))
