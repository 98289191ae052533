"""Queries on relations: joins, aggregates, windows, sets, bitemporal facts, graphs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation, memory, reports
from ..session import table
from . import domain as d
from .registry import query

POINT = "TIMESTAMP '2024-01-15 00:00:00'"
at_point = lambda: F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")


# -- aggregates and reports


@query("agg01_usage", "SELECT event_type operation, user_id%5 client, count(*) runs, sum(CASE WHEN event_type='error' THEN 1 ELSE 0 END)::BIGINT failures, sum(event_id%7)::BIGINT results, round(avg(value),6) avg_latency_ms FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL")
def agg01(spark: SparkSession, sf: str) -> DataFrame:
    return reports.usage(d.usage_runs(spark, sf), F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"))


@query("agg02_usage_daily", "SELECT strftime(ts,'%Y-%m-%d') AS day, event_type operation, count(*) runs FROM events GROUP BY ALL")
def agg02(spark: SparkSession, sf: str) -> DataFrame:
    return reports.usage_daily(d.usage_runs(spark, sf))


SHADOW = "count(*) runs, round(coalesce(avg(value),0),6) avg_overlap, max(value) max_latency_ms FROM events"


@query("agg03_shadow", f"SELECT {SHADOW}")
def agg03(spark: SparkSession, sf: str) -> DataFrame:
    return reports.shadow(d.usage_runs(spark, sf).withColumn("overlap", F.col("latency_ms")))


@query("agg04_shadow_by_project", f"SELECT user_id project, {SHADOW} GROUP BY user_id")
def agg04(spark: SparkSession, sf: str) -> DataFrame:
    return reports.shadow(d.usage_runs(spark, sf).withColumn("overlap", F.col("latency_ms")), "project")


@query("agg05_duplicate_groups", "SELECT user_id, event_type, strftime(ts,'%Y-%m-%d') AS day, count(*) n FROM events GROUP BY ALL HAVING count(*)>1")
def agg05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).where("n > 1")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("agg06_table_counts", " UNION ALL ".join(f"SELECT '{t}' table_name, count(*) n FROM {t}" for t in TABLES))
def agg06(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for t in TABLES:
        one = table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out


@query("agg14_percentiles", "SELECT event_type, round(quantile_cont(value,0.5),6) p50, round(quantile_cont(value,0.95),6) p95 FROM events GROUP BY event_type")
def agg14(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.exact_percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("agg15_index_percentile", "SELECT event_type, v[least(len(v), floor(len(v)*0.95)::BIGINT+1)] p95 FROM (SELECT event_type, list(value ORDER BY value) v FROM events GROUP BY event_type)")
def agg15(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.exact_percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p95": 0.95}, between=False)


@query("agg17_collisions", "SELECT bucket, count(*) roots, sum(notes)::BIGINT notes, count(*)>1 collides FROM (SELECT source bucket, lang root, count(*) notes FROM documents GROUP BY ALL) GROUP BY bucket")
def agg17(spark: SparkSession, sf: str) -> DataFrame:
    return reports.collisions(table(spark, sf, "documents").select(F.col("source").alias("bucket"), F.col("lang").alias("root")))


@query("agg18_outcomes", "SELECT o_orderstatus state, count(*) n FROM orders GROUP BY 1")
def agg18(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))


@query("agg20_body_groups", "SELECT sha256(trim(text, ' ')) body_sha256, count(*) members, min(doc_id) first_id FROM documents WHERE trim(text,' ')<>'' GROUP BY 1")
def agg20(spark: SparkSession, sf: str) -> DataFrame:
    body = F.btrim("text")
    return table(spark, sf, "documents").where(body != "").groupBy(F.sha2(body, 256).alias("body_sha256")).agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id"))


# -- joins


@query("joi01_inner", "SELECT o_orderstatus, count(*) n, round(sum(l_extendedprice),2) total FROM orders JOIN lineitem ON o_orderkey=l_orderkey GROUP BY 1")
def joi01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("joi02_semi", "SELECT c_custkey, c_nationkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey)")
def joi02(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_nationkey")


@query("joi03_left", "SELECT c_custkey, count(o_orderkey) orders FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def joi03(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("joi04_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey)")
def joi04(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("joi05_three_way", "SELECT p_size, s_nationkey, count(*) n FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey GROUP BY ALL")
def joi05(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    return li.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("p_size", "s_nationkey").agg(F.count("*").alias("n"))


@query("joi09_self", "SELECT a.event_id, b.event_id target_id FROM events a JOIN events b ON a.user_id=b.user_id AND a.event_type='error' AND b.event_type='purchase' AND CAST(a.ts AS DATE)=CAST(b.ts AS DATE)")
def joi09(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    a = e.where("event_type = 'error'").select("event_id", "user_id", "day")
    b = e.where("event_type = 'purchase'").select(F.col("event_id").alias("target_id"), "user_id", "day")
    return a.join(b, ["user_id", "day"]).select("event_id", "target_id")


@query("joi10_mixed_key", "SELECT kind, count(*) n FROM (SELECT 'order' kind, o_orderkey ref FROM orders UNION ALL SELECT 'line', l_orderkey FROM lineitem) r JOIN (SELECT 'order' kind, o_orderkey ref FROM orders WHERE o_orderpriority='1-URGENT') s USING (kind, ref) GROUP BY 1")
def joi10(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    refs = o.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("ref")).union(li.select(F.lit("line"), F.col("l_orderkey")))
    s = o.where("o_orderpriority = '1-URGENT'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("ref"))
    return refs.join(s, ["kind", "ref"]).groupBy("kind").agg(F.count("*").alias("n"))


# -- bitemporal facts


@query("joi12_as_of", f"WITH f AS ({d.FACTS_SQL}) SELECT fact_key, fact_id, value FROM f WHERE valid_from <= {POINT} AND (valid_to IS NULL OR valid_to > {POINT})")
def joi12(spark: SparkSession, sf: str) -> DataFrame:
    f = d.facts(spark, sf)
    return f.where(memory.valid_at(at_point())).select("fact_key", "fact_id", "value")


@query("fil04_valid_at_known_at", f"WITH f AS ({d.FACTS_SQL}) SELECT status, count(*) n FROM f WHERE valid_from <= {POINT} AND (valid_to IS NULL OR valid_to > {POINT}) AND recorded_at <= TIMESTAMP '2024-01-14 00:00:00' GROUP BY 1")
def fil04(spark: SparkSession, sf: str) -> DataFrame:
    f = d.facts(spark, sf).where(memory.valid_at(at_point())).where(F.col("recorded_at") <= F.expr("TIMESTAMP_NTZ '2024-01-14 00:00:00'"))
    return f.groupBy("status").agg(F.count("*").alias("n"))


@query("fil06_expiry", f"WITH f AS ({d.FACTS_SQL}) SELECT fact_key, fact_id FROM f WHERE valid_from <= {POINT} AND (valid_to IS NULL OR valid_to > {POINT}) AND (expires_at IS NULL OR expires_at > {POINT})")
def fil06(spark: SparkSession, sf: str) -> DataFrame:
    f = d.facts(spark, sf).where(memory.valid_at(at_point()))
    return f.where(F.col("expires_at").isNull() | (F.col("expires_at") > at_point())).select("fact_key", "fact_id")


@query("fil07_soft_supersede", f"WITH f AS ({d.FACTS_SQL}) SELECT status, count(*) n FROM f WHERE valid_from <= {POINT} AND (valid_to IS NULL OR valid_to > {POINT} OR status='superseded') GROUP BY 1")
def fil07(spark: SparkSession, sf: str) -> DataFrame:
    return d.facts(spark, sf).where(memory.valid_at(at_point(), soft=True)).groupBy("status").agg(F.count("*").alias("n"))


@query("win06_closed_intervals", f"WITH f AS ({d.FACTS_SQL}) SELECT fact_key, fact_id, valid_from, valid_to, status FROM f")
def win06(spark: SparkSession, sf: str) -> DataFrame:
    """Supersession derived from successors: each event names the one before it."""
    f = d.facts(spark, sf)
    w = Window.partitionBy("project_id", "fact_key").orderBy("valid_from", "fact_id")
    log = f.select("project_id", "fact_key", "fact_id", "valid_from", "recorded_at", F.col("fact_id").alias("event_id"), F.lag("fact_id").over(w).alias("supersedes"), F.lit("active").alias("status"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return memory.derive_facts(log).select("fact_key", "fact_id", "valid_from", "valid_to", "status")


@query("win07_first_write", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, concat(event_type,'/',CAST(CAST(ts AS DATE) AS VARCHAR)) ORDER BY ts, event_id) n FROM events) WHERE n=1")
def win07(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("recorded_at", F.col("ts")).withColumn("idempotency_key", F.concat_ws("/", "event_type", F.to_date("ts").cast("string")))
    return memory.first_write(e, ["user_id", "idempotency_key"]).select("event_id", "user_id", "event_type")


@query("win08_history", "SELECT concat(user_id,'/',event_type) fact_key, event_id fact_id, row_number() OVER w AS version, lead(ts) OVER w next_from FROM events WINDOW w AS (PARTITION BY concat(user_id,'/',event_type) ORDER BY ts, event_id)")
def win08(spark: SparkSession, sf: str) -> DataFrame:
    return memory.versions(d.facts(spark, sf)).select("fact_key", "fact_id", F.col("version").cast("long").alias("version"), "next_from")


@query("dml13_doctor", f"""WITH f AS ({d.FACTS_SQL}), g AS (SELECT *, split_part(fact_key,'/',1) u FROM f)
SELECT 'one active fact per key and scope' AS rule, min(fact_id) id FROM g WHERE status='active' GROUP BY u HAVING count(*)>1
UNION ALL SELECT 'valid_to after valid_from', fact_id FROM g WHERE valid_to <= valid_from""")
def dml13(spark: SparkSession, sf: str) -> DataFrame:
    f = d.facts(spark, sf).withColumn("fact_key", F.substring_index("fact_key", "/", 1)).withColumn("scope", F.lit("project")).withColumn("scope_id", F.lit("p")).withColumn("supersedes", F.lit(None).cast("long"))
    return memory.violations(f)


@query("top06_startup", "SELECT * FROM (SELECT source project_id, doc_id::VARCHAR ref_id, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 ELSE 0 END DESC, n_chars DESC, doc_id::VARCHAR DESC) AS position FROM documents) WHERE position<=6")
def top06(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.retrieval import startup

    kind = F.when(F.col("lang") == "en", "core").when(F.col("lang") == "de", "procedure").otherwise("episode")
    rows = table(spark, sf, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("ref_id"), kind.alias("kind"), F.col("n_chars").alias("valid_from"))
    return startup(rows, 6).select("project_id", "ref_id", F.col("position").cast("long").alias("position"))


@query("top12_pending", "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders WHERE o_orderstatus='P' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def top12(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey").limit(20)
    return first.withColumn("position", F.row_number().over(Window.orderBy("o_orderdate", "o_orderkey")).cast("long"))


# -- sets


@query("set01_union", "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def set01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").union(table(spark, sf, "labels").select("doc_id")).distinct()


@query("set03_concat", "SELECT 'order' record_type, count(*) n FROM orders UNION ALL SELECT 'line', count(*) FROM lineitem")
def set03(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").select(F.lit("order").alias("record_type"), F.col("o_orderkey").alias("ref"))
    return a.unionByName(table(spark, sf, "lineitem").select(F.lit("line").alias("record_type"), F.col("l_orderkey").alias("ref"))).groupBy("record_type").agg(F.count("*").alias("n"))


@query("set04_difference", "SELECT doc_id, 'left' side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def set04(spark: SparkSession, sf: str) -> DataFrame:
    return reports.differences(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("set05_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic=1")
def set05(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").where("toxic = 1").select("doc_id"))


@query("set07_ledger_merge", "SELECT doc_id deleted_id FROM labels WHERE toxic=1 UNION SELECT doc_id FROM labels WHERE quality=0")
def set07(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels")
    return memory.merge_ledgers(*[lab.where(c).select(F.col("doc_id").alias("deleted_id")) for c in ("toxic = 1", "quality = 0")])


@query("grf04_purge", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic=1)")
def grf04(spark: SparkSession, sf: str) -> DataFrame:
    ledger = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("deleted_id"))
    return memory.purge(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", ledger)


# -- graphs


LINEAGE = """WITH RECURSIVE e AS (SELECT 'r'||n_regionkey src, 'n'||n_nationkey dst FROM nation UNION ALL SELECT 'n'||c_nationkey, 'c'||c_custkey FROM customer
 UNION ALL SELECT 'c'||o_custkey, 'o'||o_orderkey FROM orders), r AS (SELECT 'r0' id UNION SELECT dst FROM r JOIN e ON src=id) SELECT id FROM r"""


@query("grf01_lineage", LINEAGE)
def grf01(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edge = lambda df, a, b: df.select(a.alias("src"), b.alias("dst"))
    edges = edge(table(spark, sf, "nation"), name("r", "n_regionkey"), name("n", "n_nationkey")).union(edge(table(spark, sf, "customer"), name("n", "c_nationkey"), name("c", "c_custkey"))).union(edge(table(spark, sf, "orders"), name("c", "o_custkey"), name("o", "o_orderkey")))
    return memory.closure(spark.sql("SELECT 'r0' AS id"), edges, "id")


@query("fil03_source_chains", "SELECT 'o'||o_orderkey sound_id FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_orderstatus<>'F' AND c_acctbal>=0 UNION ALL SELECT 'c'||c_custkey FROM customer WHERE c_acctbal>=0")
def fil03(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as roots, orders derived from them; closed orders and customers in debt are not live."""
    none = F.lit(None)
    extra = [none.cast("string").alias(c) for c in ("fact_id", "fact_status", "fact_source")] + [none.cast("timestamp").alias(c) for c in ("valid_from", "valid_to", "expires_at")]
    live = lambda test: F.when(test, "active").otherwise("retracted").alias("event_status")
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("event_id"), live(F.col("c_acctbal") >= 0), F.lit("").alias("event_source"), *extra)
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("event_id"), live(F.col("o_orderstatus") != "F"), F.concat(F.lit("c"), "o_custkey").alias("event_source"), *extra)
    return memory.sound_sources(c.union(o), F.lit(d.NOW).cast("timestamp"))


@query("joi15_entity_hop", "SELECT a.l_orderkey ref_id, count(DISTINCT b.l_orderkey) reached FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_partkey=b.l_partkey AND a.l_orderkey<>b.l_orderkey GROUP BY 1")
def joi15(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ref_id"), F.col("l_partkey").alias("p")).distinct()
    return a.join(a.select(F.col("ref_id").alias("other"), "p"), "p").where("ref_id <> other").groupBy("ref_id").agg(F.count_distinct("other").alias("reached"))


SEEDS = "SELECT o_orderkey FROM orders WHERE o_orderkey%50=0"


@query("grf06_entity_expand", f"""WITH l AS (SELECT DISTINCT l_orderkey::VARCHAR r, l_partkey e FROM lineitem JOIN orders ON o_orderkey=l_orderkey), s AS ({SEEDS}), t AS (SELECT o_orderkey qid, o_orderkey::VARCHAR r FROM s),
f1 AS (SELECT DISTINCT qid, e FROM t JOIN l USING (r)),
c1 AS (SELECT qid, r, count(*) shared FROM f1 JOIN l USING (e) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.qid=f1.qid AND t.r=l.r) GROUP BY ALL),
p1 AS (SELECT * FROM (SELECT c1.*, o_orderdate d, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, o_orderdate, r) n FROM c1 JOIN orders ON o_orderkey::VARCHAR=r) WHERE n<=8),
r1 AS (SELECT DISTINCT qid, e FROM p1 JOIN l USING (r)), f2 AS (SELECT * FROM r1 EXCEPT SELECT * FROM f1),
c2 AS (SELECT qid, r, count(*) shared FROM f2 JOIN l USING (e) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.qid=f2.qid AND t.r=l.r) AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.qid=f2.qid AND p1.r=l.r) GROUP BY ALL),
p2 AS (SELECT * FROM (SELECT c2.*, o_orderdate d, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, o_orderdate, r) n FROM c2 JOIN orders ON o_orderkey::VARCHAR=r) WHERE n<=8-(SELECT count(*) FROM p1 WHERE p1.qid=c2.qid))
SELECT qid query_id, r ref_id, hop::INT hop, shared, row_number() OVER (PARTITION BY qid ORDER BY hop, d, r) AS position FROM (SELECT qid, r, 1 hop, shared, d FROM p1 UNION ALL SELECT qid, r, 2, shared, d FROM p2)""".replace("(SELECT count(*) FROM p1 WHERE p1.qid=c2.qid)", "coalesce((SELECT any_value(k) FROM (SELECT qid q, count(*) k FROM p1 GROUP BY 1) WHERE q=qid),0)"))
def grf06(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.retrieval import entity_expand

    o = table(spark, sf, "orders")
    seeds = o.where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("ref_id"))
    recs = o.select(F.col("o_orderkey").cast("string").alias("ref_id"), F.col("o_orderdate").alias("recorded_at"))
    return entity_expand(seeds, recs, d.links(spark, sf)).select("query_id", "ref_id", "hop", "shared", F.col("position").cast("long").alias("position"))


@query("joi14_adjacent", """WITH u AS (SELECT *, row_number() OVER (ORDER BY ts, event_id::VARCHAR) AS p FROM events), h AS (SELECT event_id, p, row_number() OVER (ORDER BY ts, event_id::VARCHAR) AS seed FROM u WHERE event_type='signup'),
n AS (SELECT u.event_id, min(h.seed) seed FROM h JOIN u ON u.p BETWEEN h.p-2 AND h.p+2 GROUP BY 1) SELECT event_id::VARCHAR ref_id, seed FROM n WHERE event_id NOT IN (SELECT event_id FROM h)""")
def joi14(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.retrieval import adjacent, numbered

    e = table(spark, sf, "events").select(F.lit("event").alias("record_type"), F.col("event_id").cast("string").alias("ref_id"), F.col("ts").alias("recorded_at"), F.lit("p").alias("project_id"), "event_type")
    hits = numbered(e.where("event_type = 'signup'"), "recorded_at", "ref_id").select(F.lit(0).cast("long").alias("query_id"), "record_type", "ref_id", (F.col("at") + 1).alias("position"))
    return adjacent(hits, e.drop("event_type"), 2).select("ref_id", "seed")


@query("grf07_entities", "SELECT p_size::VARCHAR AS alias, max(s) entity FROM (SELECT p_size, 'x'||p_size s FROM part) GROUP BY 1")
def grf07(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "part").select(F.lit("p").alias("project_id"), F.col("p_partkey").cast("string").alias("event_id"), F.concat(F.lit("X"), "p_size").alias("name"), F.lit("size").alias("type"), F.array(F.col("p_size").cast("string")).alias("aliases"), F.lit("mentions").alias("relation"), F.lit(d.NOW).cast("timestamp").alias("recorded_at"))
    ents, aliases, _ = memory.resolve_entities(m)
    return aliases.join(ents, "entity_id").where(~F.col("alias").startswith("x")).select("alias", F.lower("name").alias("entity"))


@query("pas10_interval_union", """WITH i AS (SELECT user_id id, floor(epoch(ts))::BIGINT s, floor(epoch(ts))::BIGINT+3600 e FROM events), w AS (SELECT user_id id, floor(epoch(min(ts)))::BIGINT + 3600*k s, floor(epoch(min(ts)))::BIGINT + 3600*k + 1800 e FROM events, range(0,48) t(k) GROUP BY user_id, k),
m AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END nw FROM i), g AS (SELECT *, sum(nw) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) k FROM m),
l AS (SELECT id, min(s) lo, max(e) hi FROM g GROUP BY id, k) SELECT id, s AS start, e AS "end", EXISTS (SELECT 1 FROM l WHERE l.id=w.id AND w.s>=lo AND w.e<=hi) covered FROM w""")
def pas10(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.passages import covered

    e = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    hours = e.groupBy("id").agg(F.min("s").alias("m")).select("id", "m", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("k"))
    start = F.col("m") + 3600 * F.col("k")
    return covered(e.select("id", F.col("s").alias("start"), (F.col("s") + 3600).alias("end")), hours.select("id", start.alias("start"), (start + 1800).alias("end")))
