"""Line dedup: a sharded minimal perfect hash over repeated line hashes, probed by the documents' lines.

1. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased; keys of at least
   ``min_chars`` code points count, as two 64-bit hashes. Documents and the largest doc_id of each key are an
   aggregation with partial sums, so that a very common line sends one row a task.
2. Keys found in at least ``min_docs`` documents go, by hash, to shards of about ``SHARD_KEYS`` keys. Each shard gets a
   minimal perfect hash (levels of bit arrays) and three arrays in its order: fingerprint, count, largest doc_id.
3. The documents' keys are dealt to (shard, salt) and probe the arrays. A shard has as many salts as its lines need at
   ``GROUP`` lines each: its share of all counting lines (of which there are no more than bytes / min_chars) and the
   counts of its repeated keys, so a very common line is spread over many groups. Lines are joined with nothing.
4. A document drops the places of its lines that were found, by a difference of sorted lists of places.

Defined cases: null or empty text is one empty line; a null doc_id takes part in nothing and its row comes back as it
is; rows that share a doc_id count as one document and all lose their lines; other columns pass through ``dedup``.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SHARD_KEYS = 50_000
MIN_SHARDS = 16
GROUP = 25_000
GAMMA = 2


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, at, h1, h2), a row for each counting line of a document row; at is its place."""
    keys = F.transform(F.split(text_of(F.col("text")), "\n"), key_of)
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(keys).alias("at", "k")).where(F.length("k") >= min_chars)
    return rows.select("doc_id", "text_hash", "at", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), F.col("k")).alias("h2"))


def build(h: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """A minimal perfect hash of distinct 64-bit keys: bit arrays by level, and each key's index."""
    levels, index, left, base = [], np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    while len(left):
        m = (max(64, GAMMA * len(left)) + 7) // 8 * 8
        at = place(h[left], len(levels), m)
        alone = np.bincount(at, minlength=m) == 1
        levels.append(np.packbits(alone).tobytes())
        rank = np.cumsum(alone) - 1 + base
        hit = alone[at]
        index[left[hit]] = rank[at[hit]]
        base += int(alone.sum())
        left = left[~hit]
    return levels, index


def place(h: np.ndarray, level: int, m: int) -> np.ndarray:
    return (mix(h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(m)).astype(np.int64)


def find(levels: list[bytes], h: np.ndarray) -> np.ndarray:
    """Each key's index; for a key that wasn't built in, any index or -1."""
    index, left, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for i, bits in enumerate(levels):
        alone = np.unpackbits(np.frombuffer(bits, np.uint8))
        at = place(h[left], i, len(alone))
        hit = alone[at] == 1
        index[left[hit]] = (np.cumsum(alone, dtype=np.int64) - 1 + base)[at[hit]]
        base += int(alone.sum())
        left = left[~hit]
    return index


def folded(h1: np.ndarray, h2: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of both hashes; the seed makes those of a shard's keys distinct."""
    h1, h2 = h1.astype(np.uint64), h2.astype(np.uint64)
    return mix(h1 + np.uint64(seed)) ^ h2 if seed else h1


def shard_index(pdf: pd.DataFrame) -> pd.DataFrame:
    h1, h2, seed = pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), 0
    while len(np.unique(h := folded(h1, h2, seed))) < len(pdf):
        seed += 1
    levels, at = build(h)
    put = lambda c, kind: (lambda a: (a.__setitem__(at, pdf[c].to_numpy()), a.tobytes())[1])(np.empty(len(pdf), kind))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [seed], "levels": [levels], "prints": [put("h2", np.int64)], "counts": [put("n", np.int64)], "lasts": [put("last", np.int64)]})


def probe(lines: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    out = lines[["doc_id", "text_hash", "at"]] if len(lines) else pd.DataFrame(columns=["doc_id", "text_hash", "at"])
    if not len(lines) or not len(index):
        return out.iloc[:0]
    x = index.iloc[0]
    at = find(list(x["levels"]), folded(lines["h1"].to_numpy(), lines["h2"].to_numpy(), int(x["seed"])))
    prints, counts, lasts = (np.frombuffer(x[c], np.int64) for c in ("prints", "counts", "lasts"))
    member = (at >= 0) & (prints[at] == lines["h2"].to_numpy()) & (counts[at] > 0)
    return out[member & (lasts[at] != lines["doc_id"].to_numpy())]


def drops(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(drop_id, drop_hash, drop_at): the places of the lines that the document loses."""
    keys = line_keys(docs, min_chars)
    found = keys.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    hot = cut(found.where(F.col("n") >= min_docs), "lines")
    most = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // min_chars  # lines that count
    shards = max(MIN_SHARDS, hot.count() // SHARD_KEYS + 1)
    hot = hot.select(F.pmod(F.col("h2"), F.lit(shards)).alias("shard"), "h1", "h2", "n", "last")
    salts = hot.groupBy("shard").agg((1 + (F.sum("n") + most // shards) / GROUP).cast("int").alias("salts"))
    index = hot.groupBy("shard").applyInPandas(shard_index, "shard long, seed long, levels array<binary>, prints binary, counts binary, lasts binary")
    index = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    lines = keys.withColumn("shard", F.pmod(F.col("h2"), F.lit(shards))).join(F.broadcast(salts), "shard")  # a row for SHARD_KEYS repeated lines
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.col("salts")).cast("int")).drop("salts")
    gone = lines.groupBy("shard", "salt").cogroup(index.groupBy("shard", "salt")).applyInPandas(probe, "doc_id long, text_hash long, at int")
    return gone.groupBy(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash")).agg(F.collect_list("at").alias("drop_at"))


def kept_lines() -> Column:
    """The lines that stay, of rows with columns text and drop_at; the difference is by hash."""
    lines = F.split(text_of(F.col("text")), "\n")
    return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop_at")), lambda i: F.get(lines, i))


def with_drops(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.join(drops(ids, min_chars, min_docs), (F.col("doc_id") == F.col("drop_id")) & (F.xxhash64("text") == F.col("drop_hash")), "left")


def dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents with their own columns, text without the dropped lines, n_chars to match."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    slim = docs.select("doc_id", "text", row.alias("row"))
    text = F.when(F.col("drop_at").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(), "\n"))
    out = with_drops(slim, min_chars, min_docs).select("row", text.alias("kept"))
    fresh = {"text": F.col("kept"), "n_chars": F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.length("kept").cast("long")) if "n_chars" in docs.columns else None}
    return out.select(*[(fresh[c] if fresh.get(c) is not None else F.col("row").getField(c)).alias(c) for c in docs.columns])


def digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    df = with_drops(docs.select("doc_id", "text"), min_chars, min_docs)
    df = df.withColumn("lines", F.split(text_of(F.col("text")), "\n")).withColumn("stay", F.when(F.col("drop_at").isNotNull(), kept_lines()))
    n = F.size("lines").cast("long")
    return df.select(
        "doc_id",
        n.alias("n_lines"),
        F.when(F.col("stay").isNull(), F.lit(0)).otherwise(n - F.size("stay")).cast("long").alias("n_dropped"),
        F.sha2(F.when(F.col("stay").isNull(), text_of(F.col("text"))).otherwise(F.array_join("stay", "\n")), 256).alias("kept_sha256"),
    )
