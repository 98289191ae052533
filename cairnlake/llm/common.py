"""What the corpus operators share: lineage cuts, a hash finaliser, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, fresh, release

__all__ = ["components", "cut", "fresh", "mix", "release"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) long -> (id, component): the smallest id that links reach, for every id of an edge.

    Alternating large-star and small-star steps, each written; the driver sees a count and two checksums a round.
    Links of a hub are dealt with as rows of an aggregation, never as one collected group.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seal = lambda t: t.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    last = seal(e)
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = cut(small, "edges")
        release(e)
        e, was, last = new, last, seal(new)
        if was == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
