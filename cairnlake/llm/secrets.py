"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob, named by its SHA-256. The ledger holds, for (blob, rule version), what a scan found.
A run scans only the distinct blobs that the ledger lacks for the present rules, appends its findings as files of its
own (they count once they are committed), and joins the ledger's findings back to all paths.

Where a pattern matches is told by the pieces around its matches: the text split by the pattern, and the matches, give
by running sums of their lengths the offsets in code points. That is linear in the text, and a text with many matches is
rows, not one growing array.

Defined cases: null text is empty; rows with a null doc_id and repeated rows are paths like others; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh

# Kind, pattern, least length, group whose length counts. The first three are the base kinds.
RULES = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", r"[0-9a-f]{24,}", 24, 0),  # runs are maximal, so shorter ones needn't be found first
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 1, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1, 0),
]
BASE = 3
VERSION = hashlib.sha256(json.dumps(RULES).encode()).hexdigest()[:16]
ANY = "|".join(f"(?:{p})" if p.startswith("(?i)") else p for _, p, _, _ in RULES)


def pieces(text: Column, pattern: str, least: int, group: int) -> Column:
    """array of (gap, size, ok): code points before a match since the last one, of the match, and whether it counts."""
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part")
    )
    one = lambda x: F.struct(F.length(x["gap"]).cast("long").alias("gap"), F.length(x["hit"]).cast("long").alias("size"), (F.length(x["part"]) >= least).alias("ok"))
    return F.when(text.rlike(pattern), F.filter(F.transform(zipped, one), lambda x: x["size"].isNotNull()))


def spans(blobs: DataFrame) -> DataFrame:
    """(blob, kind, start, end) of every secret in blobs (blob, text); kind is the rule's number."""
    text = F.col("text")
    rules = F.array(*[F.struct(F.lit(i).alias("kind"), pieces(text, p, least, g).alias("found")) for i, (_, p, least, g) in enumerate(RULES)])
    rows = blobs.where(text.rlike(ANY)).select("blob", F.explode(rules).alias("r")).select("blob", "r.kind", F.posexplode("r.found").alias("i", "m"))
    upto = F.sum(F.col("m.gap") + F.col("m.size")).over(Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", upto).where("m.ok").select("blob", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end")


def joined(found: Column) -> Column:
    name = F.element_at(F.array(*[F.lit(k) for k, *_ in RULES]), found["kind"] + 1)
    return F.concat_ws(":", name, found["start"].cast("string"), found["end"].cast("string"))


def findings(blobs: DataFrame) -> DataFrame:
    """A row for every blob, with what was found in it."""
    n = [F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, (k, *_) in enumerate(RULES[:BASE])]
    got = spans(blobs).groupBy("blob").agg(*n, F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    got = got.select(
        "blob",
        *[f"n_{k}" for k, *_ in RULES[:BASE]],
        F.array_join(F.transform(F.filter("found", lambda x: x["kind"] < BASE), joined), ",").alias("base"),
        F.array_join(F.transform("found", joined), ",").alias("spans"),
    )
    return got


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{ledger}/*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
            return None
        raise


def scan(docs: DataFrame, ledger: str) -> DataFrame:
    """Bring the ledger up to date with the texts and return the findings of every path: doc_id, counts, spans."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    paths = docs.select("doc_id", text.alias("text")).withColumn("blob", F.sha2("text", 256))
    seen = read_ledger(spark, ledger)
    unseen = paths.select("blob", "text")
    if seen is not None:
        unseen = unseen.join(seen.where(F.col("rules") == VERSION).select("blob"), "blob", "left_anti")
    unseen = unseen.dropDuplicates(["blob"])
    found = findings(unseen)
    zero = {f"n_{k}": 0 for k, *_ in RULES[:BASE]}
    every = paths.select("blob").distinct()
    if seen is not None:
        every = every.join(seen.where(F.col("rules") == VERSION).select("blob"), "blob", "left_anti")
    every.join(found, "blob", "left").fillna(zero).fillna("", ["base", "spans"]).withColumn("rules", F.lit(VERSION)).write.parquet(f"{ledger}/run-{uuid.uuid4().hex}")
    known = spark.read.parquet(f"{ledger}/*").where((F.col("rules") == VERSION) & (F.col("spans") != "")).drop("rules").dropDuplicates(["blob"])
    out = paths.select("doc_id", "blob").join(known, "blob", "left").fillna(zero).fillna("", ["base", "spans"])
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in zero], F.sha2("base", 256).alias("base_sha256"), "spans", "blob")


def scan_once(docs: DataFrame) -> DataFrame:
    return scan(docs, fresh(docs.sparkSession, "ledger"))
