"""N-gram Jaccard join and its classes, by prefixes of token combinations.

Tokens are 64-bit hashes of word shingles; a document is the set of them. Two documents link when
100 * |x & y| >= percent * |x | y|.

1. Equal texts become one node (the smallest doc_id). From here on only different texts are compared.
2. Nodes are dealt to cells of about ``CELL`` bytes of text. A cell sends each distinct token once, as 32 bits packed by
   bucket of the hash and with the number of its nodes that hold it; a bucket adds up and sends back the token's
   frequency class (``CLASSES``: held by 1 node, up to 8, up to 32, ...). Tokens that share bucket and bits count as one,
   which can only make a class too high, for everybody alike.
3. Tokens are taken in order of class, then hash: the rarest first. Linked nodes share one of the first
   p = n - ceil(percent * n / 100) + 1 tokens of each, and two of the first p + 1. A token held by one node can be shared
   by none, so nodes with as many of these as the prefix is long link with nothing and are done with. The others index
   their rare tokens (classes up to ``RARE``) one by one; of frequent tokens they index combinations of two of the prefix
   extended by one, or, for sets of more than ``COMBINE`` tokens, whose combinations would be too many, single ones.
4. A bucket of the index never makes all its pairs. Every node is paired with one pivot of the bucket (the node with the
   smallest share of tokens that nobody else holds, so that edited copies meet the least edited one). Sizes and the
   places of the shared token in both orders bound the overlap and drop most pairs. The rest are verified, and linked
   nodes become components. Buckets that hold nodes of several components go on, with ``PIVOTS`` pivots, and what is
   left after that, mostly nothing, with every pair that still crosses components and may link.
5. Components of the links. Pairs within a component need no check, so no group of copies is expanded into all pairs.

Defined cases: null, empty or blank text has the empty set, which links with nothing; fewer words than a shingle make
one shingle; rows that share a doc_id are one node, each with its own size; a null doc_id stays by itself with a null
component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, mix, release
from .shingling import GOLD, Words, shingle_sets

CELL = 2 << 20
BUCKET = 4 << 20
LEAST = 16
#: Most nodes that hold a token of class 0, 1, ...; the last class has no limit.
CLASSES = np.array([1, 8, 32, 128, 512, 2048, 8192])
RARE = 2
COMBINE = 60
PIVOTS = 16

KEY = ["id", "named", "h1", "h2"]
NODES = "id long, named boolean, h1 long, h2 long, n long, alone long, keys array<long>, at array<int>, tokens binary"


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def cell_sets(pdf: pd.DataFrame, reps: pd.DataFrame, n_words: int) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """The cell's nodes in order of their key, and their sets."""
    if not len(pdf) or not len(reps):
        return pd.DataFrame(columns=[*KEY, "text"]), []
    nodes = pdf.merge(reps[KEY], on=KEY).drop_duplicates(KEY).sort_values(KEY, ignore_index=True)
    return nodes, shingle_sets(nodes["text"].tolist(), n_words, Words())


def distinct_tokens(nodes: pd.DataFrame, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of the named nodes, the place of every token among them, how many nodes hold each."""
    named = [s for s, is_named in zip(sets, nodes["named"]) if is_named]
    return np.unique(np.concatenate(named) if named else np.empty(0, np.uint64), return_inverse=True, return_counts=True)


def sent_tokens(n_words: int, buckets: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Cell -> (bucket, cell, bits, held)."""

    def run(key: tuple, pdf: pd.DataFrame, reps: pd.DataFrame) -> pd.DataFrame:
        tokens, _, held = distinct_tokens(*cell_sets(pdf, reps, n_words))
        rows = [(b, key[0], tokens[p].astype(np.uint32).tobytes(), np.minimum(held[p], 255).astype(np.uint8).tobytes()) for b, p in by_bucket(bucket_of(tokens, buckets))]
        return pd.DataFrame(rows, columns=["bucket", "cell", "bits", "held"])

    return run


def token_classes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Bucket -> (cell, bucket, data): the class of each token that the cell sent, in the order sent."""
    bits = [np.frombuffer(x, np.uint32) for x in pdf["bits"]]
    _, at = np.unique(np.concatenate(bits), return_inverse=True)
    total = np.bincount(at, np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["held"]]))
    level = np.searchsorted(CLASSES, total).astype(np.uint8)[at]
    ends = np.cumsum([len(b) for b in bits]).tolist()
    return pd.DataFrame({"cell": pdf["cell"], "bucket": key[0], "data": [level[e - len(b) : e].tobytes() for e, b in zip(ends, bits)]})


def prefix_keys(tokens: np.ndarray, level: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(index keys, place of the key's first token) of a set whose tokens have these classes."""
    n = len(tokens)
    need = -(-percent * n // 100)
    p, small = n - need + 1, need >= 2 and n * percent <= COMBINE * 100
    wide = min(n, p + small)
    alone = int((level == 0).sum())
    take = np.lexsort((tokens, level))[alone:wide]
    t, often, at = tokens[take], level[take] > RARE, np.arange(alone, max(alone, wide))
    keys, places = [t[~often]], [at[~often]]
    if not small or n > COMBINE:
        one = often & (at < p)
        keys.append(t[one])
        places.append(at[one])
    if small:
        i, j = np.triu_indices(int(often.sum()), 1)
        keys.append(mix(t[often][i] * GOLD + t[often][j]))
        places.append(at[often][i])
    return np.concatenate(keys).astype(np.int64), np.concatenate(places).astype(np.int32)


def indexed(n_words: int, percent: int, buckets: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Cell, its nodes and its tokens' classes -> NODES; nodes that can link with nothing have no keys and no tokens."""

    def run(key: tuple, pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        nodes, sets = cell_sets(pdf, told[told["bucket"] < 0] if len(told) else told, n_words)
        tokens, at, _ = distinct_tokens(nodes, sets)
        data = dict(zip(told["bucket"], told["data"])) if len(tokens) else {}
        level = np.empty(len(tokens), np.uint8)
        for b, part in by_bucket(bucket_of(tokens, buckets)):
            level[part] = np.frombuffer(data[b], np.uint8)
        every, begin, rows = level[at], 0, []
        for *node, named, h1, h2, s in zip(nodes["id"], nodes["named"], nodes["h1"], nodes["h2"], sets):
            own = every[begin : begin + len(s)] if named else every[:0]
            begin += len(own)
            keys, places = prefix_keys(s, own, percent) if len(own) else ((), ())
            rows.append((*node, named, h1, h2, len(s), int((own == 0).sum()), keys, places, s.tobytes() if len(keys) else None))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in NODES.split(", ")])

    return run


def cell_nodes(docs: DataFrame, n_words: int, percent: int) -> DataFrame:
    """NODES: a row for each distinct text (docs: KEY and text)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells, buckets = max(LEAST, size // CELL), max(LEAST, size // BUCKET)
    cell = F.pmod(F.when(F.col("named"), F.xxhash64("id")).otherwise(F.col("h1")), F.lit(cells)).alias("cell")
    first = F.coalesce(F.min(F.when(F.col("named"), F.col("id"))), F.lit(0))
    reps = docs.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(first.alias("id"), F.max("named").alias("named"), F.max("h1").alias("h1"), F.max("h2").alias("h2"))
    reps = reps.select(cell, *KEY)
    by_cell = docs.select(cell, *KEY, "text").groupBy("cell")
    sent = by_cell.cogroup(reps.groupBy("cell")).applyInPandas(sent_tokens(n_words, buckets), "bucket long, cell long, bits binary, held binary")
    told = sent.groupBy("bucket").applyInPandas(token_classes, "cell long, bucket long, data binary")
    none = F.lit(0).cast("long")
    told = told.select("cell", none.alias("id"), F.lit(False).alias("named"), none.alias("h1"), none.alias("h2"), "bucket", "data")
    told = told.union(reps.select("cell", *KEY, F.lit(-1).cast("long").alias("bucket"), F.lit(b"").alias("data")))
    return by_cell.cogroup(told.groupBy("cell")).applyInPandas(indexed(n_words, percent, buckets), NODES)


def linked(batches: Iterable[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keep = []
        for x, y in zip(pdf["tokens_a"], pdf["tokens_b"]):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        yield pdf.loc[np.array(keep, bool), ["a", "b"]]


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "tokens_a", "tokens_b")
    return both.mapInPandas(lambda it: linked(it, percent), "a long, b long")


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def may_link(percent: int) -> Column:
    """Rows (n, at) and (np, atp) of a bucket: the most that their sets can share, if this is the first token they share."""
    most = F.least(F.col("n") - F.col("at"), F.col("np") - F.col("atp"))
    return (100 + percent) * most >= percent * (F.col("n") + F.col("np"))


def crossed(rows: DataFrame) -> DataFrame:
    """Rows (k, node, n, at, alone, c) of the buckets that hold nodes of several components."""
    return rows.join(rows.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("k"), "k")


def with_pivots(rows: DataFrame, pivots: int, percent: int) -> DataFrame:
    """(a, b): the nodes of a bucket with the best node of each of its ``pivots`` parts."""
    part = F.pmod(F.xxhash64("c", F.lit(pivots)), F.lit(pivots))
    best = rows.groupBy("k", part.alias("part")).agg(F.min(F.struct((F.col("alone") * 1000 / F.col("n")).cast("int").alias("share"), "node", "n", "at", "c")).alias("p"))
    best = best.select("k", F.col("p.node").alias("nodep"), F.col("p.n").alias("np"), F.col("p.at").alias("atp"), F.col("p.c").alias("cp"))
    return rows.join(best, "k").where((F.col("c") != F.col("cp")) & may_link(percent)).select(*ordered("node", "nodep")).distinct()


def all_crossing(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of a bucket that crosses components and may link."""
    other = rows.select("k", F.col("node").alias("nodep"), F.col("n").alias("np"), F.col("at").alias("atp"), F.col("c").alias("cp"))
    return rows.join(other, "k").where((F.col("c") < F.col("cp")) & may_link(percent)).select(*ordered("node", "nodep")).distinct()


def node_labels(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, labels): verified links that make the components, and (id, component) of the nodes that have links."""
    sets = nodes.where("tokens IS NOT NULL").select(F.col("id").alias("node"), "tokens")
    rows = nodes.where("tokens IS NOT NULL").select(F.explode(F.arrays_zip("keys", "at")).alias("x"), F.col("id").alias("node"), "n", "alone")
    rows = cut(crossed(rows.select(F.col("x.keys").alias("k"), "node", "n", F.col("x.at").cast("long").alias("at"), "alone", F.col("node").alias("c"))), "index")
    tested = links = labels = None
    for step in (1, PIVOTS, None):
        at = rows
        if labels is not None:
            at = rows.drop("c").join(labels, F.col("node") == F.col("id"), "left").withColumn("c", F.coalesce("component", "node")).drop("id", "component")
            at = cut(crossed(at), "index")
            release(rows)
            rows = at
            if rows.isEmpty():
                break
        pairs = all_crossing(at, percent) if step is None else with_pivots(at, step, percent)
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = cut(verified(pairs, sets, percent), "links")
        tested = pairs if tested is None else tested.union(pairs)
        links = found if links is None else links.union(found)
        if labels is None:
            labels = components(found)
        elif not found.isEmpty():  # what is known are stars already
            labels = components(found.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    release(rows)
    return links, labels


def classes(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("named"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    nodes = cut(cell_nodes(keyed.where("text IS NOT NULL"), n_words, percent), "nodes")
    links, labels = node_labels(nodes, percent)
    told = nodes.select("h1", "h2", F.col("id").alias("node"), "named", "n").join(labels, F.expr("named AND node = id"), "left")
    told = told.select("h1", "h2", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("component"))
    out = keyed.where("text IS NOT NULL").select("doc_id", "h1", "h2").join(told, ["h1", "h2"])
    out = out.unionByName(keyed.where("text IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles")), allowMissingColumns=True)
    many = keyed.where("named AND text IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).where("lo <> hi")
    if not many.isEmpty():  # a doc_id of several texts ties their nodes together
        ties = out.where("doc_id IS NOT NULL AND component IS NOT NULL").select(F.col("component").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
        labels = components(links.union(ties.distinct()))
        out = out.drop("component").join(labels, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def dedup(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """One document (the smallest doc_id, one row of it) of each class, with its own columns; rows without doc_id stay."""
    first = classes(docs, n_words, percent).where("doc_id = component_id").select(F.col("doc_id").alias("first_id")).distinct()
    row = docs.select(F.col("doc_id").cast("long").alias("first_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = row.where("first_id IS NOT NULL").join(first, "first_id").dropDuplicates(["first_id"])
    return kept.select("row.*").union(row.where("first_id IS NULL").select("row.*"))
