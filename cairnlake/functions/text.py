"""Text functions as column expressions; Python only for what the JVM lacks (BLAKE2b, NFKC, byte-exact clipping)."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Patterns, word lists and limits that decide results.
TERM = r"[a-z0-9._-]{2,}|[一-鿿]{2,}"
CJK = r"^[一-鿿]+$"
QUERY_BREAKS = "为什么|能不能|是什么|有哪些|需要|怎么|如何|是否|哪些|什么|多少|请问|目前|现在|我们|这个|这套|本次|上次"
STOP_TERMS = ["什么", "怎么", "如何", "是否", "哪些", "多少", "请问", "目前", "现在", "我们", "这个", "这套", "本次", "上次", "可以", "需要", "了吗", "的是", "的时候"]
PARTICLES = "的了吗呢啊"
COVERAGE_TOKEN = r"[a-z0-9][a-z0-9._-]*|[一-鿿]{2,}"
COVERAGE_STOPWORDS = (
    "a an and are as at be been but by can did do does for from had has have he her his how i if in into is it its me my "
    "no not of on or our she so than that the their them they this to was we were what when where which who whom why will with would you your"
).split()
ENTITY_RUN = r"[A-Z][A-Za-z]{2,}(?:\s+[A-Z][A-Za-z]{2,}){0,2}"
ENTITY_STOPWORDS = (
    "The This That These Those There Their They Them He Her His She We Our You Your It Its And But Or So If In On At As To For "
    "When Then Than What Why How Who Which Where Yes No Not Yeah Yep Nope Well Oh Ah Ok Okay Sure Thanks Thank Hi Hello Hey Bye Good Great "
    "Maybe Actually Really Just Also Still Even Now Here Let Like Wow Haha Right Exactly Absolutely "
    "Today Tomorrow Yesterday Tonight Morning Afternoon Evening Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "January February March April May June July August September October November December I A An"
).split()
SECRETS = [
    r"(?is)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----",
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\b(?:ghp|gho|ghu|ghs|github_pat)_[A-Za-z0-9_]{16,}\b",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\beyJ[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{8,}\b",
    r"""(?i)["']?\b(password|passwd|pwd|api[_-]?key|client[_-]?secret|access[_-]?token|refresh[_-]?token|cookie)\b["']?\s*[:=]\s*["']?([^\s"'`,;，。}]{6,})""",
]
HIGH_RISK = "(?i)发布|上线|部署|验收|付款|支付|权限|账号|publish|release|deploy|accept|payment|permission|account"
QUERY_CHARS, QUERY_TERMS, FTS_TERMS, PACK_TERMS = 2048, 96, 64, 128
LEGACY_CHUNK, LEGACY_CHUNKS = r"[A-Za-z0-9._-]{3,}|[一-鿿]{3,}", 12
ENTITY_CHARS, ENTITIES = 16_000, 8
DIMENSIONS = 512
SESSION_PREFIX = "aml-session:"
RECALL_PREFIX, RECALL_CHARS = "I remember discussing: ", 4000

Words = T.ArrayType(T.StringType())


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with value worked out once, also where use hands it to a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def grams(text: Column, size: int) -> Column:
    """All substrings of a length, in order; linear in the text."""

    def of(chars: Column) -> Column:
        n = F.size(chars) - (size - 1)
        out = F.slice(chars, 1, n)
        for k in range(1, size):
            out = F.zip_with(out, F.slice(chars, k + 1, n), lambda a, b: F.concat(a, b))
        return F.when(n > 0, out).otherwise(F.array().cast(Words))

    return let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), of)


def lexical_terms(query: Column) -> Column:
    """Query terms: plain runs whole; CJK runs split at question words, short parts whole, then 3- and 2-grams."""
    chunks = found(F.lower(F.substr(query, F.lit(1), F.lit(QUERY_CHARS))), TERM)

    def part_terms(part: Column) -> Column:
        p = F.btrim(part, F.lit(PARTICLES))
        short = F.when(F.length(p) <= 12, F.array(p)).otherwise(F.array().cast(Words))
        return F.when(F.length(p) < 2, F.array().cast(Words)).otherwise(F.concat(short, grams(p, 3), grams(p, 2)))

    def chunk_terms(chunk: Column) -> Column:
        return F.when(chunk.rlike(CJK), F.flatten(F.transform(F.split(chunk, QUERY_BREAKS), part_terms))).otherwise(F.array(chunk))

    every = F.flatten(F.transform(chunks, chunk_terms))
    stop = F.array(*[F.lit(x) for x in STOP_TERMS])
    return F.slice(F.array_distinct(F.filter(every, lambda t: ~F.array_contains(stop, t))), 1, QUERY_TERMS)


def packing_terms(query: Column) -> Column:
    chunks = found(F.lower(F.substr(query, F.lit(1), F.lit(QUERY_CHARS))), TERM)
    every = F.flatten(F.transform(chunks, lambda c: F.when(c.rlike(CJK), F.concat(F.array(c), grams(c, 3), grams(c, 2))).otherwise(F.array(c))))
    return F.slice(F.array_distinct(every), 1, PACK_TERMS)


def index_terms(terms: Column) -> Column:
    """Terms that a trigram index can look up."""
    return F.slice(F.filter(terms, lambda t: F.length(t) >= 3), 1, FTS_TERMS)


def legacy_terms(query: Column) -> Column:
    return F.slice(found(F.lower(query), LEGACY_CHUNK), 1, LEGACY_CHUNKS)


def squeezed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))


def features(text: Column) -> Column:
    """2-grams and 3-grams without blanks, and word tokens marked ``w:``; repeats count."""
    plain = squeezed(text)
    compact = F.regexp_replace(plain, r"\s+", "")
    return F.concat(grams(compact, 2), grams(compact, 3), F.transform(found(plain, TERM), lambda t: F.concat(F.lit("w:"), t)))


def hashed_vector(text: Column) -> Column:
    """512-d signed feature vector: BLAKE2b-64, bucket modulo 512, sign by the top bit, unit length, float32."""

    @pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield lists.map(vector_of)

    return encode(features(F.coalesce(text, F.lit(""))))


def vector_of(items: list[str]) -> np.ndarray:
    raw = np.frombuffer(b"".join(hashlib.blake2b(x.encode(), digest_size=8).digest() for x in items), ">u8")
    sign = np.where(raw >> np.uint64(63), -1.0, 1.0)
    v = np.bincount((raw % np.uint64(DIMENSIONS)).astype(np.int64), sign, DIMENSIONS)
    norm = float(np.sqrt((v * v).sum()))
    return (v / norm if norm else v).astype(np.float32)


def md5_bucket(feature: Column) -> Column:
    """The same kind of bucket from md5, for engines without BLAKE2b: (bucket, sign) by 60 bits."""
    h = F.conv(F.substring(F.md5(feature), 1, 15), 16, 10).cast("long")
    return F.struct((h % DIMENSIONS).cast("int").alias("bucket"), F.when(F.shiftright(h, 59) == 1, -1).otherwise(1).alias("sign"))


def coverage_tokens(text: Column) -> Column:
    stop = F.array(*[F.lit(x) for x in COVERAGE_STOPWORDS])
    return F.filter(F.array_except(F.array_distinct(found(F.lower(text), COVERAGE_TOKEN)), stop), lambda t: F.length(t) >= 2)


def first_spellings(words: Column) -> Column:
    """Unique without regard to case, in order, as first spelt."""
    return let(words, lambda w: let(F.transform(w, F.lower), lambda low: F.filter(w, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def entities(text: Column) -> Column:
    """Runs of up to three capitalised words, not all of them stop words; the first of each spelling; at most 8."""
    stop = F.array(*[F.lit(x) for x in ENTITY_STOPWORDS])
    runs = F.filter(found(F.substr(text, F.lit(1), F.lit(ENTITY_CHARS)), ENTITY_RUN), lambda r: F.exists(F.split(r, r"\s+"), lambda w: ~F.array_contains(stop, w)))
    return F.slice(first_spellings(runs), 1, ENTITIES)


def has_secret(text: Column) -> Column:
    out = F.lit(False)
    for p in SECRETS:
        out = out | text.rlike(p)
    return out


def high_risk(claim: Column) -> Column:
    return claim.rlike(HIGH_RISK)


def searchable_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: ~F.lower(t).startswith(SESSION_PREFIX))


def distinct_tags(tags: Column) -> Column:
    """Trimmed, non-empty, unique without regard to case, in order."""
    return first_spellings(F.filter(F.transform(tags, lambda t: F.btrim(t)), lambda t: t != ""))


def record_text(title: Column, tags: Column, body: Column) -> Column:
    return F.concat_ws("\n", title, F.array_join(searchable_tags(tags), " "), body)


def session_tag(user: Column, session: Column) -> Column:
    return F.concat(F.lit(SESSION_PREFIX), F.substring(F.sha2(F.concat(user, F.lit("\0"), session), 256), 1, 24))


def first_session_tag(tags: Column) -> Column:
    return F.get(F.filter(tags, lambda t: t.startswith(SESSION_PREFIX)), 0)


def recall_template(query: Column) -> Column:
    return F.concat(F.lit(RECALL_PREFIX), F.substr(F.btrim(F.regexp_replace(query, r"\s+", " ")), F.lit(1), F.lit(RECALL_CHARS)))


def title_bonus(query: Column, title: Column) -> Column:
    q, t = F.lower(F.btrim(query)), F.lower(title)
    return F.when(q == t, 0.03).when((q != "") & (t.contains(q) | q.contains(t)), 0.015).otherwise(0.0)


def kind_bonus(record_type: Column, kind: Column, view: str = "current") -> Column:
    fact = (record_type == "fact") & F.lit(view == "current")
    return F.when(fact, 0.008).when(kind == "core", 0.007).when(kind == "procedure", 0.004).when(kind == "artifact_ref", 0.003).otherwise(0.0)


def sentence_units(body: Column) -> Column:
    units = F.transform(F.split(body, r"(?<=[。！？；])|(?<=[.!?;])\s+|\n+"), F.btrim)
    return F.filter(units, lambda u: u != "")


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9一-鿿._-]+", "-"), F.lit("-"))


def normal_answer(text: Column) -> Column:
    """NFKC, case folded, without white space."""

    @pandas_udf(T.StringType())
    def fold(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else "".join(unicodedata.normalize("NFKC", s).casefold().split()))

    return fold(text)


def folded(text: Column) -> Column:
    """Case folded, without white space."""

    @pandas_udf(T.StringType())
    def fold(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else "".join(s.split()).casefold())

    return fold(text)


def clip_text(text: str, allowance: int, ellipsis: bool = False) -> str:
    """The longest prefix of whole characters within ``allowance`` UTF-8 bytes; a cut shows as an ellipsis if that fits."""
    raw = memoryview(text.encode())
    if len(raw) <= allowance:
        return text
    end = "…" if ellipsis and allowance > 2 else ""
    room = max(0, allowance) - 3 * len(end)
    while room and raw[room] & 0xC0 == 0x80:  # not within a character
        room -= 1
    return str(raw[:room], "utf-8") + end


def clip(text: Column, allowance: int, ellipsis: bool = False) -> Column:
    @pandas_udf(T.StringType())
    def cut(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else clip_text(s, allowance, ellipsis))

    return cut(text)


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles; 0 for vectors of different lengths."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


# -- shaping and checking of rows

# Limits of model output and of file titles.
EXPANSIONS, EXPANSION_CHARS, HYDE_CHARS = 3, 300, 1200
FACTS, FACT_KEY_CHARS, FACT_VALUE_CHARS, UNSURE = 6, 180, 600, 0.5
TITLE_CHARS, NO_TITLE = 80, "memory-note"


def one_line(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def display_path(legacy: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(legacy, F.lit("")), path)


def probe_text(key: Column, value: Column, conditions: Column) -> Column:
    """What a fact is compared by: its key, its value, its conditions if it has any."""
    return F.concat(F.btrim(key), F.lit("\n"), value, F.when(conditions.isNotNull(), F.concat(F.lit("\nConditions: "), conditions)).otherwise(F.lit("")))


def tags_of(tags_json: Column) -> Column:
    """Searchable tags of a JSON array."""
    return searchable_tags(F.coalesce(F.from_json(tags_json, "array<string>"), F.array().cast(Words)))


def safe_title(title: Column) -> Column:
    """A file title: lower case, other characters as single hyphens, none of ``-._`` at the ends, 80 characters."""
    hyphened = F.regexp_replace(F.regexp_replace(F.lower(F.btrim(title)), r"[^a-z0-9一-鿿._-]+", "-"), "-+", "-")
    return F.coalesce(F.nullif(F.substring(F.btrim(hyphened, F.lit("-._")), 1, TITLE_CHARS), F.lit("")), F.lit(NO_TITLE))


def valid_expansions(query: Column, offered: Column, most: int = EXPANSIONS) -> Column:
    """Rewordings of a query on one line, of 300 characters at most, none the query or another one in other case."""
    lines = F.filter(F.transform(offered, one_line), lambda t: (t != "") & (F.length(t) <= EXPANSION_CHARS))
    other = F.filter(lines, lambda t: F.lower(t) != F.lower(F.btrim(query)))
    return F.slice(first_spellings(F.coalesce(other, F.array().cast(Words))), 1, most)


def valid_hyde(query: Column, expansions: Column, offered: Column) -> Column:
    """A hypothetical answer, cut to 1200 characters; empty if it says what the query or an expansion says."""
    text = F.substring(F.btrim(F.coalesce(offered, F.lit(""))), 1, HYDE_CHARS)
    said = F.concat(F.array(F.lower(F.btrim(query))), F.transform(expansions, F.lower))
    return F.when(F.array_contains(said, F.lower(F.btrim(text))), F.lit("")).otherwise(text)


def valid_facts(offered: Column, most: int = FACTS) -> Column:
    """Projected facts (key, value, confidence) on one line and cut, each (key, value) once without regard to case, with a
    confidence between 0 and 1."""
    lines = F.transform(
        offered,
        lambda f: F.struct(
            F.substring(one_line(F.coalesce(f["key"], F.lit(""))), 1, FACT_KEY_CHARS).alias("key"),
            F.substring(one_line(F.coalesce(f["value"], F.lit(""))), 1, FACT_VALUE_CHARS).alias("value"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(f["confidence"].cast("double"), F.lit(UNSURE)))).alias("confidence"),
        ),
    )
    named = F.filter(lines, lambda f: (f["key"] != "") & (f["value"] != ""))
    same = lambda f: F.lower(F.concat(f["key"], F.lit("\x1f"), f["value"]))
    return F.slice(let(named, lambda rows: let(F.transform(rows, same), lambda ids: F.filter(rows, lambda f, i: F.array_position(ids, same(f)) == i + 1))), 1, most)
