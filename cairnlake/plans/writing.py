"""Queries of the write side: what is appended, refused, decided, upserted, resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation, writes
from ..session import table
from ..sources.events import to_export
from . import domain as d
from .registry import query


def text_of(c: str) -> Column:
    return F.col(c).cast("string")


def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Usage events as event rows; a key for each user, type and last two digits."""
    e = table(spark, sf, "events")
    key = F.concat_ws(":", text_of("user_id"), "event_type", (F.col("event_id") % 50).cast("string"))
    return e.select(
        text_of("event_id").alias("event_id"), F.lit("p").alias("project_id"), F.when(F.col("event_id") % 11 == 0, "session").otherwise("project").alias("scope"), F.when(F.col("event_id") % 22 == 0, "s1").otherwise("").alias("scope_id"),
        F.when(F.col("event_id") % 17 == 0, "memo").otherwise("episode").alias("kind"), F.col("event_type").alias("title"), F.array(F.col("event_type")).alias("tags"), F.concat(F.lit(" "), "props").alias("body"), F.col("ts").alias("recorded_at"), key.alias("idempotency_key"),
    )


CHECKED = "e AS (SELECT *, event_id::VARCHAR id, concat(user_id,':',event_type,':',event_id%50) k, event_id%17=0 bad FROM events)"


@query("dml01_append", f"""WITH {CHECKED}, l AS (SELECT DISTINCT k FROM e WHERE event_id%3=0), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts, id) n FROM e WHERE NOT bad)
SELECT id event_id, CASE WHEN event_id%22=0 THEN 's1' WHEN event_id%11=0 THEN 'session' ELSE 'p' END scope_id, sha256(trim(props)) source_hash FROM f WHERE n=1 AND k NOT IN (SELECT k FROM l)""")
def dml01(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the events are in the log; all are offered."""
    rows = event_rows(spark, sf)
    added, _ = writes.append_events(rows.where(F.col("event_id").cast("long") % 3 == 0), rows)
    return added.select("event_id", "scope_id", "source_hash")


@query("dml01_refused", f"WITH {CHECKED} SELECT id event_id, 'invalid kind' refused FROM e WHERE bad")
def dml01_refused(spark: SparkSession, sf: str) -> DataFrame:
    return writes.checked_events(event_rows(spark, sf)).where(F.size("refused") > 0).select("event_id", F.array_join("refused", "; ").alias("refused"))


@query("dml02_facts", """SELECT event_id, concat(user_id,'/',event_type) fact_key, concat(event_id,'\n','Conditions: {"k":',user_id,'}') body, greatest(0.0,least(1.0,value/50))::DOUBLE confidence,
array_to_string(list_filter([CASE WHEN user_id%13=0 THEN 'invalid fact status' END, CASE WHEN event_id%2=0 THEN 'valid_to must be after valid_from' END], lambda x: x IS NOT NULL),'; ') refused FROM events""")
def dml02(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rows = e.select(
        "event_id", F.concat_ws("/", "user_id", "event_type").alias("fact_key"), text_of("event_id").alias("value_json"), F.lit("").alias("title"), F.concat(F.lit('{"k":'), text_of("user_id"), F.lit("}")).alias("conditions_json"),
        F.when(F.col("user_id") % 13 == 0, "unsure").otherwise("active").alias("status"), F.col("ts").alias("valid_from"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("valid_to"), (F.col("value") / 50).alias("confidence"), F.lit(False).alias("bound"),
    )
    return writes.fact_events(rows).select("event_id", "fact_key", "body", "confidence", F.array_join("refused", "; ").alias("refused"))


def scoped_facts(spark: SparkSession, sf: str) -> DataFrame:
    """The facts with scope, conditions and string ids; an event asserts the fact of its id."""
    f = d.facts(spark, sf)
    return f.withColumns({"fact_id": text_of("fact_id"), "assertion_event_id": text_of("fact_id"), "scope": F.lit("project"), "scope_id": F.lit("p"), "conditions_json": F.lit(None).cast("string")})


@query("dml04_checked_facts", f"""WITH f AS ({d.FACTS_SQL}), l AS (SELECT * FROM f WHERE fact_id%2=0), n AS (SELECT fact_id, fact_key, valid_from, CASE WHEN fact_id%3=0 THEN fact_id-1 END s FROM f WHERE fact_id%2=1),
a AS (SELECT DISTINCT fact_key FROM l WHERE status='active')
SELECT n.fact_id::VARCHAR event_id, CASE WHEN s IS NOT NULL AND NOT coalesce(o.status='active' AND o.fact_key=n.fact_key, false) THEN 'superseded fact must be active with the same key and scope' WHEN s IS NOT NULL AND n.valid_from<o.valid_from THEN 'supersession cannot precede the previous valid_from' WHEN s IS NULL AND a.fact_key IS NOT NULL THEN 'active fact already exists in this scope' ELSE '' END refused
FROM n LEFT JOIN l o ON o.fact_id=n.s LEFT JOIN a ON a.fact_key=n.fact_key""")
def dml04(spark: SparkSession, sf: str) -> DataFrame:
    """Facts with odd ids are offered to those with even ones, a third as successors of the fact before them."""
    f = scoped_facts(spark, sf)
    odd = F.col("fact_id").cast("long") % 2 == 1
    events = f.where(~odd).select("project_id", F.col("fact_id").alias("event_id"), "scope", "scope_id", F.lit("active").alias("status"))
    follows = F.when(F.col("fact_id").cast("long") % 3 == 0, (F.col("fact_id").cast("long") - 1).cast("string"))
    new = f.where(odd).select("project_id", F.col("fact_id").alias("event_id"), "fact_key", "scope", "scope_id", F.lit("active").alias("status"), "valid_from", F.lit("").alias("source_event_id"), follows.alias("supersedes"))
    return writes.checked_facts(new, events, f.where(~odd), F.lit(d.NOW).cast("timestamp")).select("event_id", F.array_join("refused", "; ").alias("refused"))


@query("dml05_supersede", f"WITH f AS ({d.FACTS_SQL}) SELECT fact_key, fact_id::VARCHAR supersedes, concat('supersede:',fact_id,':',sha256((fact_id%7)::VARCHAR)) idempotency_key FROM f WHERE status='active' AND fact_id%5=0")
def dml05(spark: SparkSession, sf: str) -> DataFrame:
    f = scoped_facts(spark, sf)
    n = F.col("fact_id").cast("long")
    changes = f.where(n % 5 == 0).select("project_id", F.col("fact_id").alias("old_fact_id"), (n % 7).cast("string").alias("value_json"), "valid_from", F.lit(0.9).alias("confidence"))
    return writes.supersede(f, changes.union(changes))[0].select("fact_key", "supersedes", "idempotency_key")


@query("dml07_submit", """WITH p AS (SELECT doc_id, concat('{"from":"',source,'","lang":"',lang,'","size":',n_chars%40,'}') j FROM documents), x AS (SELECT DISTINCT sha256(j) k FROM p WHERE doc_id%5=0)
SELECT concat('cand-',substr(sha256(concat('p',chr(31),sha256(j))),1,32)) candidate_id, sha256(j) idempotency_key, min(doc_id) first_doc FROM p WHERE sha256(j) NOT IN (SELECT k FROM x) GROUP BY j""")
def dml07(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of which many are the same; a fifth were submitted before."""
    payload = F.concat(F.lit('{"from":"'), "source", F.lit('","lang":"'), "lang", F.lit('","size":'), (F.col("n_chars") % 40).cast("string"), F.lit("}"))
    rows = table(spark, sf, "documents").select("doc_id", F.lit("p").alias("project_id"), payload.alias("payload_json"), F.lit("").alias("idempotency_key"), F.timestamp_seconds("doc_id").alias("created_at"))
    none = spark.createDataFrame([], "candidate_id string, project_id string, payload_json string, state string, reason string, idempotency_key string, created_at timestamp, updated_at timestamp")
    before, _ = writes.submit(none, rows.where("doc_id % 5 = 0").drop("doc_id"))
    added, _ = writes.submit(before, rows.drop("doc_id"))
    return added.select("candidate_id", "idempotency_key", F.unix_timestamp("created_at").alias("first_doc"))


def customer_candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decided, facts, matches): a candidate a customer, a fact an order, some of them near duplicates."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    decided = c.select(text_of("c_custkey").alias("candidate_id"), F.when(F.col("c_acctbal") > 0, "validated").otherwise("rejected").alias("state"), F.lit("policy").alias("reason"))
    key = F.col("o_orderkey")
    facts = o.select(text_of("o_custkey").alias("candidate_id"), key.alias("position"), F.col("o_orderpriority").alias("fact_key"), F.when(key % 7 == 0, "old").otherwise("").alias("supersedes"))
    near = o.where(key % 50 == 0).select(text_of("o_custkey").alias("candidate_id"), key.alias("position"), F.col("o_orderpriority").alias("candidate_fact_key"), F.concat(F.lit("f"), text_of("o_orderkey")).alias("fact_id"), F.when(key % 100 == 0, "other").otherwise(F.col("o_orderpriority")).alias("fact_key"), F.lit(0.9).alias("similarity"))
    return decided, facts, near


CANDIDATES = """c AS (SELECT c_custkey::VARCHAR id, CASE WHEN c_acctbal>0 THEN 'validated' ELSE 'rejected' END state FROM customer), f AS (SELECT o_custkey::VARCHAR id, o_orderkey k, o_orderkey%50=0 AND o_orderkey%7<>0 hit, o_orderkey%100<>0 same FROM orders),
h AS (SELECT id, count(*) n, bool_and(same) same FROM f WHERE hit GROUP BY 1)"""


@query("dml09_review", f"WITH {CANDIDATES} SELECT id candidate_id, CASE WHEN state='validated' AND n IS NOT NULL THEN 'needs_confirmation' WHEN state='validated' THEN 'active' ELSE state END state FROM c LEFT JOIN h USING (id)")
def dml09(spark: SparkSession, sf: str) -> DataFrame:
    return writes.consolidate(*customer_candidates(spark, sf), "review")[0].select("candidate_id", "state")


@query("dml09_skip", f"WITH {CANDIDATES} SELECT id candidate_id, CASE WHEN state='validated' THEN 'active' ELSE state END state, CASE WHEN state='validated' THEN coalesce(n,0) ELSE 0 END::BIGINT skipped FROM c LEFT JOIN h USING (id)")
def dml09_skip(spark: SparkSession, sf: str) -> DataFrame:
    return writes.consolidate(*customer_candidates(spark, sf), "skip")[0].select("candidate_id", "state", "skipped")


@query("dml09_supersede", f"WITH {CANDIDATES} SELECT f.id candidate_id, k AS position, CASE WHEN hit THEN 'f'||k WHEN k%7=0 THEN 'old' ELSE '' END supersedes FROM f JOIN c USING (id) LEFT JOIN h USING (id) WHERE state='validated' AND coalesce(h.same, true)")
def dml09_supersede(spark: SparkSession, sf: str) -> DataFrame:
    return writes.consolidate(*customer_candidates(spark, sf), "supersede")[1].select("candidate_id", "position", "supersedes")


@query("dml10_precheck", f"WITH {CANDIDATES} SELECT id candidate_id, CASE WHEN state='validated' AND n IS NOT NULL AND NOT same THEN 'needs_confirmation' ELSE state END state FROM c LEFT JOIN h USING (id)")
def dml10(spark: SparkSession, sf: str) -> DataFrame:
    decided, facts, near = customer_candidates(spark, sf)
    return writes.override(decided, near.join(facts.where("supersedes = ''").select("candidate_id", "position"), ["candidate_id", "position"], "left_semi"), "supersede").select("candidate_id", "state")


@query("dml11_review", """SELECT o_orderkey::VARCHAR candidate_id, CASE WHEN o_orderstatus='F' THEN o_orderstatus WHEN o_orderkey%2=0 THEN CASE WHEN o_orderkey%3=0 THEN 'pending' ELSE s END ELSE 'rejected' END state,
CASE WHEN o_orderstatus='F' THEN 'candidate is not awaiting review' ELSE '' END || CASE WHEN o_orderkey%2=0 AND o_orderkey%3<>0 THEN CASE WHEN o_orderstatus='F' THEN '; ' ELSE '' END||'approval requires verifiable evidence' ELSE '' END refused FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'needs_confirmation' ELSE o_orderstatus END s FROM orders)""")
def dml11(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "needs_confirmation").otherwise(F.col("o_orderstatus"))
    rows = o.select(F.lit("p").alias("project_id"), text_of("o_orderkey").alias("candidate_id"), state.alias("state"))
    asked = o.select(F.lit("p").alias("project_id"), text_of("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderkey") % 2 == 0, "approve").otherwise("reject").alias("decision"), (F.col("o_orderkey") % 3 == 0).alias("evidence_valid"))
    return writes.review(rows, asked).select("candidate_id", "state", F.array_join("refused", "; ").alias("refused"))


@query("txn02_finish", "SELECT o_orderkey candidate_id, CASE WHEN o_orderkey%2=0 AND o_orderkey%3<>0 AND o_orderstatus='O' THEN 'done' ELSE o_orderstatus END state FROM orders")
def txn02(spark: SparkSession, sf: str) -> DataFrame:
    """Results read from the table as it was: a third have changed since."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("candidate_id"), F.col("o_orderstatus").alias("state"), F.lit("").alias("reason"), F.col("o_orderdate").alias("updated_at"))
    at = F.when(F.col("candidate_id") % 3 == 0, F.col("updated_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("updated_at"))
    results = o.where("candidate_id % 2 = 0").select("candidate_id", F.lit("done").alias("state"), F.lit("ok").alias("reason"), F.lit("O").alias("read_state"), at.alias("read_at"))
    return writes.finish(o, results, F.lit(d.NOW).cast("timestamp_ntz")).select("candidate_id", "state")


@query("dml16_upsert", "WITH r AS (SELECT s_nationkey project_id, s_name root, s_suppkey t FROM supplier UNION ALL SELECT c_nationkey, c_name, c_custkey FROM customer) SELECT project_id, arg_max(root, struct_pack(t, c:=root LIKE 'Cust%')) root, max(t) created_at FROM r GROUP BY 1")
def dml16(spark: SparkSession, sf: str) -> DataFrame:
    """Projects of suppliers, then of customers; the last of a nation stays."""
    old = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("project_id"), F.col("s_name").alias("root"), F.col("s_suppkey").alias("created_at"))
    new = table(spark, sf, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("root"), F.col("c_custkey").alias("created_at"))
    return writes.upsert(old, new, ["project_id"], "created_at")


@query("joi08_project_of", "SELECT c_name path, n_name display_name FROM customer JOIN nation ON n_nationkey=c_nationkey WHERE c_acctbal>0")
def joi08(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    aliases = c.select(F.col("c_name").alias("alias_path"), F.col("c_nationkey").alias("project_id"), (F.col("c_acctbal") > 0).alias("active"))
    projects = table(spark, sf, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("display_name"))
    return writes.project_of(c.select(F.col("c_name").alias("path")), aliases, projects).select("path", "display_name")


@query("dml14_alias", "SELECT c_mktsegment alias_path, arg_max(c_nationkey, c_custkey) project_id, bool_or(c_custkey=m AND c_custkey%2=0) OR arg_max(c_acctbal>0, c_custkey) active FROM customer JOIN (SELECT c_mktsegment, max(c_custkey) m FROM customer GROUP BY 1) USING (c_mktsegment) GROUP BY 1")
def dml14(spark: SparkSession, sf: str) -> DataFrame:
    """Segments as paths: odd customers had them, even ones register them anew."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("alias_path"), F.col("c_nationkey").alias("project_id"), (F.col("c_acctbal") > 0).alias("active"), F.col("c_custkey").alias("created_at"))
    return writes.add_alias(c.where("created_at % 2 = 1"), c.where("created_at % 2 = 0").drop("active")).select("alias_path", "project_id", "active")


@query("dml15_migrate", "SELECT o_clerk path, h source_hash FROM (SELECT concat('notes/',doc_id) o_clerk, sha256(text) h, doc_id FROM documents) WHERE doc_id%3<>0")
def dml15(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as legacy files; a third are there unchanged, a third in another version."""
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("notes/"), text_of("doc_id"))
    files = docs.select(path.alias("path"), F.sha2("text", 256).alias("source_hash"))
    events = docs.where("doc_id % 3 < 2").select(path.alias("source_legacy_path"), F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).otherwise("old").alias("source_hash"))
    return writes.to_migrate(files, events)


@query("set02_targets", "WITH e AS (SELECT event_id::VARCHAR t, event_id::VARCHAR e, 0 p FROM events WHERE event_id%2=0 UNION ALL SELECT event_id::VARCHAR, 'a'||event_id, 1 FROM events WHERE event_id%3=0) SELECT t target_id, arg_min(e, p) event_id FROM e GROUP BY 1")
def set02(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that are events, facts, or both."""
    e = table(spark, sf, "events")
    rows = e.where("event_id % 2 = 0").select(F.lit("p").alias("project_id"), text_of("event_id").alias("event_id"))
    facts = e.where("event_id % 3 = 0").select(F.lit("p").alias("project_id"), text_of("event_id").alias("fact_id"), F.concat(F.lit("a"), text_of("event_id")).alias("assertion_event_id"))
    return writes.resolve_targets(rows, facts, e.select(F.lit("p").alias("project_id"), text_of("event_id").alias("target_id"))).select("target_id", "event_id")


@query("set06_missing", "SELECT o_custkey batch_id, o_orderkey event_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity>40) AND o_orderkey%9<>0")
def set06(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as a batch: those without a large line are missing, but for some deleted ones."""
    o = table(spark, sf, "orders")
    markers = o.groupBy(F.col("o_custkey").alias("batch_id")).agg(F.collect_list("o_orderkey").alias("event_ids"))
    seen = table(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("event_id"))
    return writes.missing_members(markers, seen, o.where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("deleted_id"))).select("batch_id", "event_id")


@query("joi13_source_events", "WITH h AS (SELECT l_suppkey q, l_orderkey e, min(l_partkey) p FROM lineitem GROUP BY ALL) SELECT q query_id, p AS position, e::VARCHAR event_id FROM h JOIN orders ON o_orderkey=e WHERE o_orderstatus='O' AND o_orderkey%4<>0")
def joi13(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as hits of suppliers, ranked by part; their orders as events, some of them facts."""
    here = [F.lit("project").alias("scope"), F.lit("p").alias("scope_id")]
    hits = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("position"), text_of("l_orderkey").alias("source_event_id"), *here)
    events = table(spark, sf, "orders").select(
        text_of("o_orderkey").alias("event_id"), *here, F.when(F.col("o_orderkey") % 4 == 0, "fact").otherwise("episode").alias("kind"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("retracted").alias("status"), F.lit("").alias("operation"), F.col("o_orderpriority").alias("body"), F.col("o_orderdate").alias("observed_at")
    )
    return writes.source_events(hits, events).select("query_id", "position", "event_id")


@query("ret12_add", "WITH m AS (SELECT conv_id%20 u, conv_id%7 r, turn i, min(text) b FROM conversations WHERE trim(coalesce(text,''))<>'' GROUP BY ALL) SELECT concat('add:',sha256(concat(u,chr(31),r)),':',i) idempotency_key, b body FROM m WHERE i%3<>0")
def ret12(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as messages of requests that are sent again and again; every third place was stored before."""
    rows = d.messages(spark, sf).select((F.col("session") % 20).cast("string").alias("user_id"), (F.col("session") % 7).cast("string").alias("request_id"), F.col("position").alias("index"), "body")
    none = spark.createDataFrame([], "idempotency_key string")
    return writes.add_messages(writes.add_messages(none, rows.where("index % 3 = 0")), rows).select("idempotency_key", "body")


# -- shaping


@query("prj01_display_path", "SELECT page_id, coalesce(nullif(CASE WHEN page_id%2=0 THEN '' ELSE url END,''),'page-'||page_id) AS path FROM pages")
def prj01(spark: SparkSession, sf: str) -> DataFrame:
    legacy = F.when(F.col("page_id") % 2 == 0, "").otherwise(F.col("url"))
    return table(spark, sf, "pages").select("page_id", tx.display_path(legacy, F.concat(F.lit("page-"), text_of("page_id"))).alias("path"))


@query("prj05_probe_text", """SELECT p_partkey, concat(trim(' '||p_brand),chr(10),p_name,CASE WHEN p_size%2=0 THEN concat(chr(10),'Conditions: {"size":',p_size,'}') ELSE '' END) probe FROM part""")
def prj05(spark: SparkSession, sf: str) -> DataFrame:
    conditions = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"size":'), text_of("p_size"), F.lit("}")))
    return table(spark, sf, "part").select("p_partkey", tx.probe_text(F.concat(F.lit(" "), "p_brand"), F.col("p_name"), conditions).alias("probe"))


@query("jsn03_tags", "SELECT doc_id, concat(lang,',',source) tags FROM documents")
def jsn03(spark: SparkSession, sf: str) -> DataFrame:
    made = F.to_json(F.array("lang", F.concat(F.lit(tx.SESSION_PREFIX), "source"), "source"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.tags_of(made), ",").alias("tags"))


@query("str19_safe_title", "SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(regexp_replace(translate(trim(text[1:300], chr(32)||chr(10)||chr(9)||chr(13)),'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ','abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ'),'[^a-z0-9一-鿿._-]+','-','g'),'-+','-','g'),'-._'),80),''),'memory-note') title FROM documents")
def str19(spark: SparkSession, sf: str) -> DataFrame:
    """Titles from the first 300 characters of each text."""
    head = F.btrim(F.substring("text", 1, 300), F.lit(" \n\t\r"))
    return table(spark, sf, "documents").select("doc_id", tx.safe_title(head).alias("title"))


@query("llm01_expansions", r"""WITH o AS (SELECT doc_id, trim(source) q, list_filter(list_transform(string_split(coalesce(text,''),chr(10)), lambda x: trim(regexp_replace(x,'[ \t\n\x0b\f\r]+',' ','g'))), lambda t: t<>'' AND length(t)<=300 AND lower(t)<>lower(trim(source))) l FROM documents),
u AS (SELECT doc_id, list_filter(l, lambda t, i: list_position(list_transform(l, lambda y: lower(y)), lower(t))=i)[1:3] e FROM o) SELECT doc_id, array_to_string(e,'|') expansions FROM u""")
def llm01(spark: SparkSession, sf: str) -> DataFrame:
    """A text's lines as what a model offers."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(tx.valid_expansions(F.col("source"), F.split(F.coalesce("text", F.lit("")), "\n")), "|").alias("expansions"))


@query("llm02_facts", """WITH f AS (SELECT o_custkey, o_orderkey, upper(o_orderpriority) k, o_orderstatus v, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderkey) n FROM orders), g AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) r FROM f WHERE n=1)
SELECT o_custkey candidate_id, string_agg(concat(CASE WHEN o_orderkey%2=0 THEN k ELSE lower(k) END,'=',v), ';' ORDER BY o_orderkey) facts FROM g WHERE r<=6 GROUP BY 1""")
def llm02(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders as offered facts, keys in either case."""
    key = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    fact = F.struct("o_orderkey", F.struct(F.concat(F.lit("  "), key).alias("key"), F.col("o_orderstatus").alias("value"), F.lit(3.0).alias("confidence")).alias("f"))
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("candidate_id")).agg(F.transform(F.array_sort(F.collect_list(fact)), lambda x: x["f"]).alias("offered"))
    valid = rows.withColumn("v", tx.valid_facts(F.col("offered")))
    return valid.select("candidate_id", F.array_join(F.transform("v", lambda f: F.concat(f["key"], F.lit("="), f["value"])), ";").alias("facts"))


# -- evaluation


@query("eva11_ingest", """SELECT concat('src-',doc_id) source_id, concat('eval-source:src-',doc_id) idempotency_key, lang project_id, coalesce(trim(text),'') body FROM documents""")
def eva11(spark: SparkSession, sf: str) -> DataFrame:
    src = table(spark, sf, "documents").select(F.concat(F.lit("src-"), text_of("doc_id")).alias("source_id"), F.col("lang").alias("project"), F.col("source").alias("title"), F.coalesce("text", F.lit("")).alias("body"))
    return evaluation.ingest_sources(src).select("source_id", "idempotency_key", "project_id", "body")


@query("agg24_reader_matches", """WITH q AS (SELECT item_id, item_id%5=0 absent, text a, CASE WHEN item_id%7=0 THEN NULL WHEN item_id%3=0 THEN replace(text,' ','  ') ELSE 'other' END h, item_id%10=0 abst FROM benchmark)
SELECT count(*) questions, count(*) FILTER (h IS NULL) missing_predictions, round(count(*) FILTER (CASE WHEN absent THEN h IS NOT NULL AND abst ELSE h IS NOT NULL AND NOT abst AND h<>'other' END)/count(*),6) normalized_exact_match, round(count(*) FILTER (absent AND h IS NOT NULL AND abst)/count(*) FILTER (absent),6) explicit_abstention_accuracy FROM q""")
def agg24(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    n = F.col("item_id")
    said = F.when(n % 3 == 0, F.regexp_replace("text", " ", "  ")).otherwise("other")
    predictions = b.where(n % 7 != 0).select(n.alias("question_id"), said.alias("hypothesis"), (n % 10 == 0).alias("abstained"))
    return evaluation.reader_matches(b.select(n.alias("question_id"), (n % 5 == 0).alias("unanswerable"), F.array("text").alias("accepted")), predictions)


@query("agg25_grades", "SELECT source baseline, count(*) graded_cases, round(avg(quality::DOUBLE),6) accuracy FROM labels JOIN documents USING (doc_id) WHERE doc_id%3<>0 GROUP BY 1")
def agg25(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as grades of documents; every third document has changed since."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("baseline"), text_of("doc_id").alias("question_id"), F.when(F.col("doc_id") % 3 == 0, "new").otherwise("same").alias("record_sha256"))
    grades = table(spark, sf, "labels").select(text_of("doc_id").alias("question_id"), (F.col("quality") == 1).alias("correct"), F.lit("same").alias("prediction_sha256")).join(docs.select("question_id", "baseline"), "question_id")
    return evaluation.import_grades(docs, grades)[0]


@query("agg16_summary", """WITH s AS (SELECT lang, quality=1 ok, toxic=0 answerable FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL), e AS (SELECT lang, count(*) n, count(*) FILTER (doc_id%2=0) a, count(*) FILTER (doc_id%2=1) u FROM documents GROUP BY 1)
SELECT lang, n expected, coalesce(c,0) completed, n-coalesce(c,0) pending, round(coalesce(x,0)/n,6) exact_match_rate, round(coalesce(y,0)/a,6) answerable_exact_match, round(coalesce(z,0)/u,6) abstention_accuracy FROM e LEFT JOIN (SELECT lang, count(*) c, count(*) FILTER (ok) x, count(*) FILTER (ok AND answerable) y, count(*) FILTER (NOT answerable AND ok) z FROM s GROUP BY 1) USING (lang)""")
def agg16(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as outcomes of documents; rates over all documents of a language."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    ok, answerable = F.col("quality") == 1, F.col("toxic") == 0
    scored = docs.join(labels, "doc_id").select(
        "lang", answerable.alias("answerable"), F.array().cast("array<string>").alias("flags"), F.lit(True).alias("format_valid"), F.lit(True).alias("contract_valid"), answerable.alias("answered"), ok.alias("exact_match"), (ok & ~answerable).alias("correct_abstention")
    )
    expected = evaluation.expected_cases(docs.select("lang", (F.col("doc_id") % 2 == 1).alias("unanswerable")), "lang")
    return evaluation.summary(scored, expected, "lang").select("lang", "expected", "completed", "pending", "exact_match_rate", "answerable_exact_match", "abstention_accuracy")


@query("eva07_span_gold", """WITH s AS (SELECT doc_id, CASE WHEN doc_id%4=0 THEN 'quote' WHEN length(text) < 40 THEN 'range' END f FROM documents WHERE doc_id%3<>0 AND text IS NOT NULL)
SELECT doc_id::VARCHAR question_id, f fault FROM s WHERE f IS NOT NULL UNION ALL SELECT doc_id::VARCHAR, 'no spans' FROM documents WHERE doc_id%3=0 AND text IS NOT NULL""")
def eva07(spark: SparkSession, sf: str) -> DataFrame:
    """A span of 40 characters in each text; some have a wrong digest, some texts are too short, some have none."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    key = text_of("doc_id").alias("question_id")
    home = [F.col("lang").alias("project"), F.lit("project").alias("scope"), F.lit("").alias("scope_id")]
    questions = docs.select(key, F.lit(False).alias("unanswerable"), F.array(text_of("doc_id")).alias("required_source_ids"), *home)
    sources = docs.select(text_of("doc_id").alias("source_id"), F.col("text").alias("body"), *home)
    quote = F.when((F.col("doc_id") % 4 == 0) & (F.length("text") >= 40), "x").otherwise(F.substring("text", 1, 40))
    spans = docs.where("doc_id % 3 <> 0").select(key, F.lit("e").alias("evidence_id"), text_of("doc_id").alias("source_id"), F.lit(0).alias("start"), F.lit(40).alias("end"), F.sha2(quote, 256).alias("quote_sha256"))
    found = evaluation.span_faults(spans, questions, sources)
    return found.join(docs.select(key, (F.length("text") < 40).alias("short"), (F.col("doc_id") % 4 == 0).alias("fourth")), "question_id").select("question_id", F.when(F.col("short") & F.col("fourth") & (F.col("fault") == "range"), "quote").otherwise(F.col("fault")).alias("fault"))


@query("eva08_presented", """WITH d AS (SELECT n_chars%97 q, source s, count(*) n, any_value(lang) b, count(DISTINCT lang) l FROM documents GROUP BY ALL) SELECT q::VARCHAR question_id, s source_id FROM d WHERE n=1""")
def eva08(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads that show a source for each document; one shown twice doesn't count."""
    record = F.struct(F.col("source").alias("source_id"), F.col("lang").alias("body"))
    cases = table(spark, sf, "documents").groupBy((F.col("n_chars") % 97).cast("string").alias("question_id")).agg(F.to_json(F.struct(F.collect_list(record).alias("sources"))).alias("payload")).withColumn("baseline", F.lit("b"))
    return evaluation.presented_records(cases).select("question_id", "source_id")


@query("eva09_rubric_faults", "SELECT o_custkey::VARCHAR question_id, CASE WHEN count(*)>1 THEN 'duplicate' ELSE 'unknown' END fault FROM orders LEFT JOIN customer ON c_custkey=o_custkey AND c_acctbal>0 GROUP BY 1 HAVING count(*)>1 OR max(c_custkey) IS NULL")
def eva09(spark: SparkSession, sf: str) -> DataFrame:
    rubrics = table(spark, sf, "orders").select(text_of("o_custkey").alias("question_id"))
    return evaluation.rubric_faults(rubrics, table(spark, sf, "customer").where("c_acctbal > 0").select(text_of("c_custkey").alias("question_id")))


RESUME = """c AS (SELECT c_custkey k, c_mktsegment m FROM customer), p AS (SELECT o_custkey k, count(*) n, min(o_orderkey) o FROM orders GROUP BY 1)"""


@query("eva10_resume", f"WITH {RESUME} SELECT k::VARCHAR question_id FROM c LEFT JOIN p USING (k) WHERE o IS NULL OR n>1 OR o%3=0 OR o%5=0")
def eva10(spark: SparkSession, sf: str) -> DataFrame:
    """Cases still to be answered: customers without exactly one order, or with one of another run or of another case."""
    base = [F.lit("b").alias("baseline"), F.lit("s").alias("sources_sha256")]
    cases = table(spark, sf, "customer").select(text_of("c_custkey").alias("question_id"), F.col("c_mktsegment").alias("messages_sha256"), *base)
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    message = F.when(F.col("o_orderkey") % 5 == 0, "changed").otherwise(F.col("c_mktsegment"))
    run = F.when(F.col("o_orderkey") % 3 == 0, "r0").otherwise("r1")
    predictions = o.select(text_of("o_custkey").alias("question_id"), message.alias("messages_sha256"), *base, run.alias("run_fingerprint"), F.lit("d").alias("record_sha256"), F.lit("d").alias("digest"))
    return evaluation.resume(cases, predictions, "r1")[2].select("question_id")


@query("eva04_run", """WITH s AS (SELECT doc_id, lang, quality=1 ok FROM documents JOIN labels USING (doc_id)), e AS (SELECT lang, count(*) n FROM documents GROUP BY 1)
SELECT NULL category, (SELECT count(*) FROM documents) expected, (SELECT count(*) FROM s) completed, round((SELECT count(*) FROM s WHERE ok)/(SELECT count(*) FROM documents),6) exact_match_rate
UNION ALL SELECT lang, n, (SELECT count(*) FROM s WHERE s.lang=e.lang), round((SELECT count(*) FROM s WHERE ok AND s.lang=e.lang)/n,6) FROM e""")
def eva04(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    no = F.lit(False)
    scored = docs.join(labels, "doc_id").select(
        text_of("doc_id").alias("question_id"), F.lit("b").alias("baseline"), F.lit(True).alias("answerable"), F.array().cast("array<string>").alias("flags"), F.lit(True).alias("format_valid"), F.lit(True).alias("contract_valid"), F.lit(True).alias("answered"), (F.col("quality") == 1).alias("exact_match"), no.alias("correct_abstention")
    )
    questions = docs.select(text_of("doc_id").alias("question_id"), F.col("lang").alias("category"), no.alias("unanswerable"))
    return evaluation.run_summary(scored, questions, spark.createDataFrame([("b",)], "baseline string")).select("category", "expected", "completed", "exact_match_rate")


@query("snk05_export", """SELECT n_name project_root, concat(strftime(o_orderdate,'%Y-%m-%d'),'-',lower(o_orderpriority[1:1]),'-',substr(o_orderkey::VARCHAR,1,8),'.md') file, o_orderkey::VARCHAR body FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey WHERE o_orderstatus='O' AND o_orderkey%5<>0 AND o_orderdate>=TIMESTAMP '1995-01-01'""")
def snk05(spark: SparkSession, sf: str) -> DataFrame:
    """Open orders as events of their nation, titled by their priority's number; a fifth were imported."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    events = o.select(
        F.col("n_name").alias("project_root"), text_of("o_orderkey").alias("event_id"), F.substring("o_orderpriority", 1, 1).alias("title"), F.array("o_orderpriority").alias("tags"), text_of("o_orderkey").alias("body"), F.col("o_orderdate").alias("recorded_at"),
        F.when(F.col("o_orderstatus") == "O", "active").otherwise("retracted").alias("status"), F.lit("").alias("operation"), F.when(F.col("o_orderkey") % 5 == 0, "legacy_import").otherwise("agent").alias("source"),
    )
    return to_export(events, F.lit("1995-01-01").cast("timestamp_ntz")).select("project_root", "file", "body")
