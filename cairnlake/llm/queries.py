"""The corpus queries of the driver contract: opN_<name>(spark, sf_dir) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import captures

    return captures(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_once

    return scan_once(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import classes

    return classes(table(spark, sf_dir, "documents"), n_words=3, percent=90)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import predict

    return predict(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import digest

    return digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_decontamination, op3_secrets, op4_suffix_dedup, op5_html, op6_jaccard, op7_packing, op8_language, op9_quality, op10_line_dedup)}
BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """WITH p AS (SELECT page_id, encode(coalesce(html,'')) b FROM pages), h AS (SELECT page_id, b, sha1(b)||'00' h, max(page_id) OVER (PARTITION BY b) top FROM p)
SELECT page_id, octet_length(b)::BIGINT payload_bytes,
 array_to_string([('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[((('0x'||substr(h,(5*i)//4+1,3))::INT >> (7-(5*i)%4)) & 31)+1] for i in range(0,32)], '') payload_digest,
 CASE WHEN page_id=top THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id<>top THEN top END refers_to FROM h"""

OP4 = """WITH b AS (SELECT doc_id, encode(coalesce(text,'')) t FROM documents), x AS (SELECT doc_id, t, octet_length(t)::BIGINT n FROM b),
w AS (SELECT doc_id, i, t[i+1:i+50] g FROM (SELECT doc_id, t, unnest(range(0, greatest(n-49,0))) i FROM x)),
m AS (SELECT g, min(doc_id) lo FROM w GROUP BY g), c AS (SELECT doc_id, i FROM w JOIN m USING (g) WHERE lo<doc_id),
k AS (SELECT doc_id, i, sum(CASE WHEN i <= prev+50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) k FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) prev FROM c)),
s AS (SELECT doc_id, min(i) a, max(i)+50 e FROM k GROUP BY doc_id, k),
z AS (SELECT doc_id, a, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a),0) f FROM (SELECT doc_id, a, e FROM s UNION ALL SELECT doc_id, n, n+1 FROM x)),
q AS (SELECT z.doc_id, string_agg(CASE WHEN a>f THEN hex(t[f+1:a]) ELSE '' END, '' ORDER BY a) kept FROM z JOIN x USING (doc_id) GROUP BY 1)
SELECT x.doc_id, n n_bytes, coalesce(r,0)::BIGINT n_removed, coalesce(cnt,0)::BIGINT n_spans, sha256(unhex(kept)) kept_sha256
FROM x JOIN q USING (doc_id) LEFT JOIN (SELECT doc_id, sum(e-a) r, count(*) cnt FROM s GROUP BY 1) USING (doc_id)"""

OP6 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text,'')")}, '[\\x20\\x09-\\x0D]+'), lambda v: v<>'') w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w)=0 THEN [] WHEN len(w)<3 THEN [array_to_string(w,' ')] ELSE list_distinct([w[i]||' '||w[i+1]||' '||w[i+2] for i in range(1,len(w)-1)]) END sh FROM w),
e AS (SELECT doc_id, len(sh)::BIGINT n FROM s), x AS (SELECT doc_id, unnest(sh) g FROM s),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) m FROM x a JOIN x b USING (g) WHERE a.doc_id<b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN e ea ON ea.doc_id=a JOIN e eb ON eb.doc_id=b WHERE 100*m >= 90*(ea.n+eb.n-m)), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id s, doc_id t FROM documents UNION SELECT r.s, u.b FROM r JOIN u ON u.a=r.t)
SELECT e.doc_id, n n_shingles, c component_id FROM e JOIN (SELECT s, min(t) c FROM r GROUP BY 1) ON s=e.doc_id"""

OP10 = f"""WITH a AS (SELECT doc_id, string_split(coalesce(text,''), chr(10)) v FROM documents), l AS (SELECT doc_id, unnest(v) line, generate_subscripts(v,1) i FROM a),
k AS (SELECT *, {LOWER.format(f"trim(line, {BLANKS})")} key FROM l), h AS (SELECT key, max(doc_id) last FROM k WHERE length(key)>=40 GROUP BY key HAVING count(DISTINCT doc_id)>=5),
j AS (SELECT k.doc_id, line, i, h.last IS NOT NULL AND h.last<>k.doc_id gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*) n_lines, count(*) FILTER (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone),'')) kept_sha256 FROM j GROUP BY doc_id"""

#: The other operators have no SQL: token ids, learnt models, positions of matches and HTML are beyond it; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_warc": OP1, "op4_suffix_dedup": OP4, "op6_jaccard": OP6, "op10_line_dedup": OP10}
