"""Suffix-array dedup: shard Burrows-Wheeler transforms, merged by iterative interleave refinement.

Wanted: every byte covered by a ``MATCH``-byte string that also starts in a document with a smaller doc_id.

1. Documents are dealt to cells by doc_id, a cell being about ``CELL`` bytes of text. In a cell each MATCH-byte window
   has a minimizer, its leftmost least-hashed ``GRAM``-byte string; windows in a row with the same minimizer form a run.
   Equal windows have equal minimizers, so two documents can share a window only where they share a minimizer.
2. A cell sends each distinct minimizer once, packed by bucket of the hash. Buckets say which occur in two documents
   (or perhaps do: they compare 32 bits more than the bucket number, and a chance hit only costs work).
3. For those the cells send the runs' texts, each distinct text once, with its smallest doc_id. All windows that are
   equal anywhere meet in one bucket, whatever document they come from, so no document needs to be whole there.
4. A bucket collapses equal run texts, splits the others over ``SHARDS``, sorts each shard's suffixes and takes its
   Burrows-Wheeler transform. The transforms are merged: the interleave, at first shard after shard, is refined one
   character a round by a stable distribution of the transforms' characters, and after MATCH rounds the suffixes without
   a boundary between them are the intervals with a common prefix of MATCH bytes. No suffix is sorted anew, and a round
   takes only the suffixes from which it is still as many characters to a window's start as there are rounds to come. The
   smallest doc_id of an interval goes back to the runs.
5. Cells mark, for each document, the windows whose smallest doc_id is below its own, and digest what is left.

A very common passage is one row a cell in steps 2 to 4, so no task gathers a group of copies.

Defined cases: null text is empty; a null doc_id takes part in nothing and loses nothing; rows that share a doc_id lose
nothing to each other; documents shorter than MATCH bytes are whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

MATCH = 50
GRAM = 24
CELL = 2 << 20
BUCKET = 4 << 20
LEAST = 256
SHARDS = 4
#: Windows that are hashed at once, so that a long text needs no long arrays.
BLOCK = 1 << 15
BASE = 0x9E3779B97F4A7C15 | 1


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position: polynomial, by doubling, then mixed."""
    h, n, made, at, power = raw.astype(np.uint64) + np.uint64(1), 1, None, 0, BASE
    rest = GRAM
    while rest:
        if rest & 1:
            made = h.copy() if made is None else made[: len(h) - at] * np.uint64(power) + h[at:]
            at += n
        rest >>= 1
        if rest:
            h, n, power = h[: len(h) - n] * np.uint64(power) + h[n:], 2 * n, power * power & (1 << 64) - 1
    return mix(made)


def window_minima(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least hash of each window and its leftmost position."""
    m, p, n = h, np.arange(len(h), dtype=np.int32), 1

    def joined(gap: int) -> tuple[np.ndarray, np.ndarray]:
        right, left = m[gap:], m[: len(m) - gap]
        return np.minimum(left, right), np.where(right < left, p[gap:], p[: len(p) - gap])

    while 2 * n <= width:
        (m, p), n = joined(n), 2 * n
    return joined(width - n) if width > n else (m, p)


def text_hashes(grams: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of the whole text of each run, from the hashes of grams that cover it and its length.

    A minimizer serves MATCH - GRAM + 1 windows at most, so a run has 4 * GRAM bytes at most.
    """
    last = first + sizes + MATCH - 1 - GRAM
    h = sizes.astype(np.uint64)
    for at in (first, np.minimum(first + GRAM, last), np.minimum(first + 2 * GRAM, last), last):
        h = mix(h * np.uint64(BASE) + grams[at])
    return h


def runs_of(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimizer hash, text hash) of each run of texts that lie end to end, block by block.

    A window may not cross a text's end. A block's end may cut a run in two, which is harmless: both parts go to the
    minimizer's bucket.
    """
    starts, sizes, hashes, whole = [], [], [], []
    data = np.frombuffer(raw, np.uint8)
    windows = len(data) - MATCH + 1
    for lo in range(0, windows, BLOCK):
        hi = min(windows, lo + BLOCK)
        grams = gram_hashes(data[lo : hi - 1 + MATCH])
        m, p = window_minima(grams, MATCH - GRAM + 1)
        fits = np.ones(hi - lo, bool)
        inner = ends[np.searchsorted(ends, lo + 1) : np.searchsorted(ends, hi + MATCH)]
        for e in inner.tolist():  # windows from e - MATCH + 1 to e - 1 cross it
            fits[max(0, e - MATCH + 1 - lo) : max(0, e - lo)] = False
        change = np.empty(hi - lo, bool)
        change[0] = True
        change[1:] = (p[1:] != p[:-1]) | (fits[1:] != fits[:-1])
        first = np.flatnonzero(change)
        n = np.diff(np.append(first, hi - lo))
        keep = fits[first]
        first, n = first[keep], n[keep]
        starts.append(first + lo)
        sizes.append(n)
        hashes.append(m[first])
        whole.append(text_hashes(grams, first, n))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(hashes), np.concatenate(whole)


class Cell:
    """The texts of a cell end to end, in order of doc_id, and all their runs."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values(["doc_id", "text"])
        self.ids = pdf["doc_id"].to_numpy(np.int64)
        texts = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
        self.raw, self.ends = b"".join(texts), np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.begins = self.ends - [len(t) for t in texts]
        self.start, self.size, self.hash, self.whole = runs_of(self.raw, self.ends)
        self.doc = np.searchsorted(self.ends, self.start, side="right")

    def texts(self, runs: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Sizes of the runs' texts, and the texts end to end."""
        n = self.size[runs] + MATCH - 1
        at = np.arange(n.sum()) + np.repeat(self.start[runs] - (np.cumsum(n) - n), n)
        return n, np.frombuffer(self.raw, np.uint8)[at].tobytes()


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def low_bits(h: np.ndarray) -> np.ndarray:
    return h.astype(np.uint32)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def minimizers(buckets: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Cell -> (bucket, cell, bits, many): distinct minimizers; many holds those of two documents of the cell."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell = Cell(pdf)
        order = np.lexsort((cell.doc, cell.hash))
        h, ids = cell.hash[order], cell.ids[cell.doc[order]]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        last = np.append(first[1:], len(h)) - 1 if len(h) else first
        h, many = h[first], ids[first] != ids[last]
        rows = [(b, key[0], low_bits(h[p]).tobytes(), np.packbits(many[p]).tobytes()) for b, p in by_bucket(bucket_of(h, buckets))]
        return pd.DataFrame(rows, columns=["bucket", "cell", "bits", "many"])

    return run


def shared_minimizers(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Bucket -> (cell, bucket, bits): each cell's minimizers that occur in another document too."""
    bits = [np.frombuffer(x, np.uint32) for x in pdf["bits"]]
    many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(b)).astype(bool) for m, b in zip(pdf["many"], bits)]
    every = np.concatenate(bits)
    order = np.argsort(every, kind="stable")
    e = every[order]
    same = np.concatenate([[False], e[1:] == e[:-1]])
    twice = same.copy()
    twice[:-1] |= same[1:]
    hit = np.empty(len(e), bool)
    hit[order] = twice
    at, rows = 0, []
    for cell, b, m in zip(pdf["cell"], bits, many):
        keep = hit[at : at + len(b)] | m
        at += len(b)
        if keep.any():
            rows.append((cell, key[0], b[keep].tobytes()))
    return pd.DataFrame(rows, columns=["cell", "bucket", "bits"])


def run_texts(buckets: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Cell and its shared minimizers -> (bucket, cell, runs, bits, lows, sizes, texts): distinct run texts, first run, minimizer, smallest id."""

    def run(key: tuple, pdf: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pdf) and len(shared):
            cell = Cell(pdf)
            wanted = {b: np.frombuffer(x, np.uint32) for b, x in zip(shared["bucket"], shared["bits"])}
            for b, part in by_bucket(bucket_of(cell.hash, buckets)):
                if b not in wanted:
                    continue
                part = part[np.isin(low_bits(cell.hash[part]), wanted[b])]
                if not len(part):
                    continue
                # runs are in order of doc_id: the first of a text has the smallest
                first = part[np.unique(cell.whole[part], return_index=True)[1]]
                sizes, texts = cell.texts(first)
                rows.append((b, key[0], first.astype(np.uint32).tobytes(), low_bits(cell.hash[first]).tobytes(), cell.ids[cell.doc[first]].tobytes(), sizes.astype(np.uint32).tobytes(), texts))
        return pd.DataFrame(rows, columns=["bucket", "cell", "runs", "bits", "lows", "sizes", "texts"])

    return run


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of texts that each end in a 0, in order of their bytes up to their 0, then of position."""
    n = len(text)
    left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(n)  # bytes before the 0
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | np.where(i < left, padded[i : n + i], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    k = key[order]
    rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
    h, longest = 8, int(left.max()) if n else 0
    while h <= longest:
        r = rank[order]
        tied = np.zeros(n, bool)
        same = r[1:] == r[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        who = order[at]
        after = np.where(left[who] > h, rank[np.minimum(who + h, n - 1)] + 1, 0)
        sub = np.lexsort((who, after, rank[who]))
        order[at] = who[sub]
        pair_r, pair_a = rank[who][sub], after[sub]
        new = np.concatenate([[True], (pair_r[1:] != pair_r[:-1]) | (pair_a[1:] != pair_a[:-1])])
        # a group keeps the rank of its first place, which leaves room for its parts
        head = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        lead = np.concatenate([[True], pair_r[1:] != pair_r[:-1]])
        base = np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))
        if h == 8:
            first_of = np.empty(n, np.int64)
            starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            first_of[order] = np.repeat(starts, np.diff(np.append(starts, n)))
            rank = first_of
        rank[order[at]] = rank[order[at]] + (head - base)
        h *= 2
    return order


def transform(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Burrows-Wheeler transform, suffix order, text index of each position) of texts without 0 bytes."""
    text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    order = suffix_order(text, ends)
    return np.where(order > 0, text[order - 1], 0).astype(np.uint8), order, np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[-1], ends])))


def merged_groups(bwts: list[np.ndarray], tails: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes that start a window of ``depth`` characters, sorted by these, and the group of
    equal ones at each place.

    A place holds a suffix's number in the concatenation of the shards' own orders. Each round puts, by the character
    before them, the suffixes that are one longer; a shard's own order never changes, only how the shards interleave.
    tails marks, in a shard's order, the suffixes that are ``depth`` characters behind a window's start: they come first,
    in one group, and after ``depth`` rounds the windows' suffixes are what is left of them. Others never matter.
    """
    longer, base = [], 0
    for bwt in bwts:  # where each suffix's one-longer suffix stands in its own shard
        order = np.argsort(bwt, kind="stable")
        to = np.empty(len(bwt), np.int32)
        to[order] = np.arange(base, base + len(bwt), dtype=np.int32)
        longer.append(to)
        base += len(bwt)
    before, longer = np.concatenate(bwts), np.concatenate(longer)
    at = np.flatnonzero(np.concatenate(tails)).astype(np.int32)
    g = np.zeros(len(at), np.int32)
    for _ in range(depth):
        chars = before[at]
        order = np.argsort(chars, kind="stable")
        c, go = chars[order], g[order]
        new = np.zeros(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (go[1:] != go[:-1])
        at, g = longer[at[order]], np.cumsum(new, dtype=np.int32)
    return at, g


def smallest(texts: list[bytes], lows: np.ndarray) -> np.ndarray:
    """For each window of each text, end to end, the smallest low of a text that has the window."""
    shards = [np.arange(i, len(texts), SHARDS) for i in range(min(SHARDS, len(texts)))]
    made = [transform([texts[i] for i in s]) for s in shards]
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes - MATCH + 1)])
    tails, low, slot = [], [], []
    for s, (_, order, of) in zip(shards, made):
        text = of[order]
        offset = order - (np.cumsum(sizes[s] + 1) - sizes[s] - 1)[text]
        tails.append(offset >= MATCH)
        low.append(lows[s[text]])
        slot.append(begin[s[text]] + offset)
    at, g = merged_groups([m[0] for m in made], tails, MATCH)
    low, slot = np.concatenate(low)[at], np.concatenate(slot)[at]
    least = np.minimum.reduceat(low, np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])))
    out = np.empty(begin[-1], np.int64)
    out[slot] = least[g]
    return out


def smallest_plain(texts: list[bytes], lows: np.ndarray) -> np.ndarray:
    """The same for texts with 0 bytes, which would pass for ends in a transform: the windows sorted from their last byte."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    n = sizes - MATCH + 1
    start = np.arange(n.sum()) + np.repeat((np.cumsum(sizes) - sizes) - (np.cumsum(n) - n), n)
    at, g = np.arange(len(start)), np.zeros(len(start), np.int64)
    for back in range(MATCH - 1, -1, -1):
        chars = data[start[at] + back]
        order = np.argsort(chars, kind="stable")
        c, go = chars[order], g[order]
        new = np.zeros(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (go[1:] != go[:-1])
        at, g = at[order], np.cumsum(new)
    least = np.minimum.reduceat(np.repeat(lows, n)[at], np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])))
    out = np.empty(len(start), np.int64)
    out[at] = least[g]
    return out


def bucket_lows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Bucket -> (cell, runs, parts, lengths, lows): for each run text the smallest id by stretch of windows."""
    index: dict[bytes, int] = {}
    mins: list[int] = []
    gram: list[int] = []
    rows = []
    for cell, runs, bits, lows, sizes, texts in zip(pdf["cell"], pdf["runs"], pdf["bits"], pdf["lows"], pdf["sizes"], pdf["texts"]):
        ends = np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64)).tolist()
        at, which = 0, []
        for e, low, x in zip(ends, np.frombuffer(lows, np.int64).tolist(), np.frombuffer(bits, np.uint32).tolist()):
            t = texts[at:e]
            at = e
            i = index.setdefault(t, len(index))
            if i == len(mins):
                mins.append(low)
                gram.append(x)
            elif low < mins[i]:
                mins[i] = low
            which.append(i)
        rows.append((cell, runs, which))
    texts_of, mins_of = list(index), np.array(mins, np.int64)
    # a text whose minimizer no other text has needs no comparison
    grams = Counter(gram)
    mixed = [i for i, x in enumerate(gram) if grams[x] > 1]
    stretches: dict[int, list[tuple[int, int]]] = {}
    if len(mixed) > 1:
        some = [texts_of[i] for i in mixed]
        low = (smallest_plain if any(b"\0" in t for t in some) else smallest)(some, mins_of[mixed])
        stretches = dict(zip(mixed, stretched(low, np.array([len(t) - MATCH + 1 for t in some]))))
    out = []
    for cell, runs, which in rows:
        told = [stretches.get(i) or [(len(texts_of[i]) - MATCH + 1, int(mins_of[i]))] for i in which]
        flat = [x for s in told for x in s]
        out.append((cell, runs, np.array([len(s) for s in told], np.uint32).tobytes(), np.array([n for n, _ in flat], np.uint32).tobytes(), np.array([m for _, m in flat], np.int64).tobytes()))
    return pd.DataFrame(out, columns=["cell", "runs", "parts", "lengths", "lows"])


def stretched(low: np.ndarray, windows: np.ndarray) -> list[list[tuple[int, int]]]:
    """Each text's (windows, smallest id) by stretch, from all texts' windows end to end."""
    begins = np.concatenate([[0], np.cumsum(windows)[:-1]])
    change = np.concatenate([[True], low[1:] != low[:-1]])
    change[begins] = True
    first = np.flatnonzero(change)
    pairs = list(zip(np.diff(np.append(first, len(low))).tolist(), low[first].tolist()))
    cuts = [*np.searchsorted(first, begins).tolist(), len(pairs)]
    return [pairs[a:b] for a, b in zip(cuts, cuts[1:])]


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(key: tuple, pdf: pd.DataFrame, lows: pd.DataFrame) -> pd.DataFrame:
    """Cell and its runs' smallest ids -> the documents' digests."""
    if not len(pdf):
        return pd.DataFrame(columns=[x.split()[0] for x in DIGEST.split(", ")])
    if not len(lows):
        pdf = pdf.sort_values(["doc_id", "text"])
        return pd.DataFrame([whole(int(d), t.encode("utf-8", "surrogatepass")) for d, t in zip(pdf["doc_id"], pdf["text"])], columns=[x.split()[0] for x in DIGEST.split(", ")])
    cell = Cell(pdf)
    join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in lows[c]]).astype(np.int64)
    first, parts, lengths, values = join("runs", np.uint32), join("parts", np.uint32), join("lengths", np.uint32), join("lows", np.int64)
    # all runs with the text of a first run, and the stretches of each
    order = np.argsort(cell.whole[first], kind="stable")
    known = cell.whole[first][order]
    near = np.minimum(np.searchsorted(known, cell.whole), len(known) - 1)
    runs = np.flatnonzero(known[near] == cell.whole)
    which = order[near[runs]]
    count = parts[which]
    of = np.repeat(np.arange(len(runs)), count)
    begin = np.cumsum(count) - count
    stretch = np.arange(len(of)) + ((np.cumsum(parts) - parts)[which] - begin)[of]
    n = lengths[stretch]
    ahead = np.cumsum(n) - n
    at = cell.start[runs][of] + ahead - ahead[begin][of]
    doc = cell.doc[runs][of]
    hit = values[stretch] < cell.ids[doc]
    at, end, doc = at[hit], at[hit] + n[hit] - 1 + MATCH, doc[hit]
    # stretches are in order; those that touch within a document are one span
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > reach[:-1])
    lead = np.flatnonzero(new)
    lo, hi, doc = at[lead], reach[np.append(lead[1:], len(at)) - 1] if len(lead) else at[lead], doc[lead]
    cuts = np.searchsorted(doc, np.arange(len(cell.ids) + 1)).tolist()
    lo, hi, out = lo.tolist(), hi.tolist(), []
    for d, (name, begin_d, end_d) in enumerate(zip(cell.ids.tolist(), cell.begins.tolist(), cell.ends.tolist())):
        a, b = cuts[d], cuts[d + 1]
        if a == b:
            out.append(whole(name, cell.raw[begin_d:end_d]))
            continue
        kept, from_here = hashlib.sha256(), begin_d
        for x, y in zip(lo[a:b], hi[a:b]):
            kept.update(cell.raw[from_here:x])
            from_here = y
        kept.update(cell.raw[from_here:end_d])
        out.append((name, end_d - begin_d, sum(hi[a:b]) - sum(lo[a:b]), b - a, kept.hexdigest()))
    return pd.DataFrame(out, columns=[x.split()[0] for x in DIGEST.split(", ")])


def whole(doc: int, raw: bytes) -> tuple:
    return doc, len(raw), 0, 0, hashlib.sha256(raw).hexdigest()


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells, buckets = max(LEAST, size // CELL), max(LEAST, size // BUCKET)
    named = docs.where("doc_id IS NOT NULL").select(F.pmod(F.xxhash64("doc_id"), F.lit(cells)).alias("cell"), "doc_id", "text")
    by_cell = named.groupBy("cell")
    seen = by_cell.applyInPandas(minimizers(buckets), "bucket long, cell long, bits binary, many binary")
    shared = seen.groupBy("bucket").applyInPandas(shared_minimizers, "cell long, bucket long, bits binary")
    texts = by_cell.cogroup(shared.groupBy("cell")).applyInPandas(run_texts(buckets), "bucket long, cell long, runs binary, bits binary, lows binary, sizes binary, texts binary")
    lows = texts.groupBy("bucket").applyInPandas(bucket_lows, "cell long, runs binary, parts binary, lengths binary, lows binary")
    out = by_cell.cogroup(lows.groupBy("cell")).applyInPandas(digests, DIGEST)
    size_of = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    unnamed = docs.where("doc_id IS NULL").select("doc_id", size_of.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return out.union(unnamed)
