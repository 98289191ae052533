"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A seed is the hash of the tokens at the positions that a fixed mask keeps. Any ``WINDOW`` tokens with two substitutions
or fewer agree, somewhere in the window, on all kept positions of one of the ``MASKS`` (checked by a test over all
pairs of positions). Shorter items are compared whole: their positions fall into two groups more than there may be
substitutions, and the ``short_masks`` keep all but that many groups, so some mask misses any substitutions allowed; they
are looked for only where the benchmark has items of that length. Seeds of all documents are joined with those of all benchmark items; a hit gives a document, an
item and a diagonal. There the tokens are compared: a document is contaminated if some window of WINDOW tokens of the
item (of the whole item if that is shorter) has at least ``SHARE`` percent of them in the same places.

The benchmark side is broadcast only up to ``BROADCAST_SEEDS`` seeds, counted first; beyond that the join is shuffled.
Documents are read again for the comparison by the ids that have hits, which are counted: up to ``BROADCAST_IDS`` they are
broadcast, so that only these documents move; beyond that their texts are joined by a shuffle. Tokens are lower-cased runs of letters and digits, so case and punctuation make no difference.

Defined cases: null, empty or blank texts contaminate and are contaminated by nothing; items of 1 to 4
tokens flag every document that has them verbatim; repeated rows are flagged alike; a null doc_id or item_id takes part in
nothing; other columns are ignored (``clean`` passes them on); empty tables give no pairs.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release

# Kept positions.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 2, 5, 6, 7, 8))
WINDOW = 13
SHARE = 80
BROADCAST_SEEDS = 500_000
BROADCAST_IDS = 1_000_000


def tokens(text: Column) -> Column:
    """Hashes of the tokens."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.xxhash64(t))


def short_masks(n: int) -> list[tuple[int, tuple[int, ...]]]:
    """(first position, kept positions from there) of the masks for items of n tokens, n < WINDOW."""
    wrong = n * (100 - SHARE) // 100
    kept = [[i for i in range(n) if i * (wrong + 2) // n not in left_out] for left_out in combinations(range(wrong + 2), wrong)]
    return [(k[0], tuple(i - k[0] for i in k)) for k in kept]


def seeds(mask: tuple[int, ...]) -> Column:
    """The mask's seeds of column t, in order of position."""
    at = lambda i: F.xxhash64(*[F.get("t", i + p) for p in mask])
    last = F.size("t") - (mask[-1] + 1)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at))


def seeded(rows: DataFrame, masks: list[tuple[int, ...]], *keep: str) -> DataFrame:
    """(keep, mask, at, seed) of rows with tokens t."""
    every = F.array(*[F.struct(F.lit(i).alias("mask"), seeds(m).alias("found")) for i, m in enumerate(masks)])
    return rows.select(*keep, F.explode(every).alias("m")).select(*keep, "m.mask", F.posexplode("m.found").alias("at", "seed"))


def small(rows: DataFrame, most: int) -> DataFrame:
    """rows, to be broadcast if there are no more than ``most``."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shift) where a document and an item share a seed; docs and items have tokens t."""
    short = {n: short_masks(n) for (n,) in items.select(F.size("t")).where(F.size("t") < WINDOW).distinct().collect()}  # fewer than WINDOW rows
    masks = list(MASKS) + sorted({m for found in short.values() for _, m in found} - set(MASKS))
    theirs = seeded(items.where(F.size("t") >= WINDOW), list(MASKS), "item_id").select("item_id", "mask", F.col("at").alias("item_at"), "seed")
    for n, found in sorted(short.items()):
        whole = [F.struct(F.lit(masks.index(m)).alias("mask"), F.lit(at).alias("item_at"), F.xxhash64(*[F.get("t", F.lit(at + p)) for p in m]).alias("seed")) for at, m in found]
        theirs = theirs.union(items.where(F.size("t") == n).select("item_id", F.inline(F.array(*whole))))
    theirs = small(theirs.distinct(), BROADCAST_SEEDS)
    ours = seeded(docs, masks, "doc_id")
    return ours.join(theirs, ["seed", "mask"]).select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()


def best_window(shift: Column) -> Column:
    """Most equal tokens in a window, of item tokens i against document tokens t moved by shift."""
    n = F.size("i")
    same = F.transform("i", lambda x, k: F.when(F.get("t", k + shift) == x, 1).otherwise(0))
    w = F.least(n, F.lit(WINDOW))
    return F.array_max(F.transform(F.sequence(F.lit(0), n - w), lambda s: F.aggregate(F.slice(same, s + 1, w), F.lit(0), lambda a, b: a + b)))


def hit_lists(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shifts), written: a pair's distinct shifts, of which there are no more than it has tokens."""
    found = hits(docs.select("doc_id", tokens(F.col("text")).alias("t")), items)
    return cut(found.groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts")), "hits")


def compared(docs: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_same, n_window): each contaminated pair with its best window."""
    texts = docs.join(small(found.select("doc_id").distinct(), BROADCAST_IDS), "doc_id", "left_semi")
    both = found.join(items.select("item_id", F.col("t").alias("i")), "item_id").join(texts.select("doc_id", tokens(F.col("text")).alias("t")), "doc_id")
    w = F.least(F.size("i"), F.lit(WINDOW))
    best = F.array_max(F.transform("shifts", best_window))
    pairs = both.select("doc_id", "item_id", best.alias("n_same"), w.alias("n_window")).where(F.col("n_same") * 100 >= F.col("n_window") * SHARE)
    return pairs.groupBy("doc_id", "item_id").agg(F.max("n_same").cast("long").alias("n_same"), F.max("n_window").cast("long").alias("n_window"))


def sides(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return docs, items


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_same, n_window): each contaminated pair with its best window."""
    docs, items = sides(docs, items)
    return compared(docs, items, hit_lists(docs, items))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that share no window with an item, with their own columns."""
    ours, theirs = sides(docs, items)
    found = hit_lists(ours, theirs)
    bad = cut(compared(ours, theirs, found).select(F.col("doc_id").alias("bad_id")).distinct(), "flagged")
    release(found)
    row = docs.select(F.col("doc_id").cast("long").alias("bad_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.join(small(bad, BROADCAST_IDS), "bad_id", "left_anti").select("row.*")
