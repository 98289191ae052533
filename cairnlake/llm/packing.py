"""Packing of token ids into windows: bounded-space online best-fit with a fixed number of open windows.

Each partition keeps ``OPEN`` windows of ``WINDOW`` tokens. A document's full windows are cut off first; what remains
goes to the open window that it fills best. Where none has room, the fullest window is filled up with a cut of the
piece and emitted, the rest goes on. At the partition's end the leftovers are merged: concatenated, cut at WINDOW, and
the tail is cut into sequences of power-of-two length, so that no sequence needs padding.
Memory: OPEN windows of pieces and one batch of documents, whatever the partition's size.

Defined cases: null text is empty, and an empty document is its end id alone; null doc_id, repeated rows and other
columns change nothing: each row is packed by itself. An empty table gives an empty result.
Sequence ids are partition * 2^40 + a count, gapless within a partition only.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
OPEN = 64
ENDED = np.array([1], "<u4")
CACHE_IDS = 500_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# Fixed value: the split pattern of the tokenizer file; a space ends a run.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\x20")
#: What the short way leaves: blanks, marks, characters that compose, and what special tokens begin with.
ODD = re.compile("[^ !-~\u00a1-\u024f]|<\\|")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: byte -> character of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
BYTE_CHARS = {**{b: chr(b) for b in PRINTABLE}, **{b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in PRINTABLE)}}
#: Between the ids of two runs; no id has a high byte other than 0, so it is found nowhere else.
BETWEEN = b"\xff\xff\xff\xff"
#: Characters of texts whose new runs are looked up together; a longer text is by itself.
SLICE_CHARS = 4 << 20


@lru_cache(1)
def tokenizer(path: str) -> object:
    """Read once a worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Pieces(dict):
    """A lower-case piece -> its token ids, as unsigned 32-bit little-endian bytes."""

    def __init__(self, model: object) -> None:
        super().__init__({" ": BETWEEN})
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_IDS:
            self.clear()
            self[" "] = BETWEEN
        text = piece if piece.isascii() else "".join(map(BYTE_CHARS.__getitem__, piece.encode()))
        tokens = self.model.tokenize(text)
        ids = self[piece] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids


class Ids(dict):
    """A run of non-blanks -> its token ids, as such bytes. The tokenizer drops white space and joins nothing across it.

    Plain runs are lower-cased and split here, all new ones of a slice at once, and only their pieces go to the model; any
    other goes to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        self.pieces = Pieces(self.tokenizer.model)

    def learn(self, runs: list[str]) -> None:
        new = [*filterfalse(self.__contains__, runs)]
        if len(self) + len(new) > CACHE_IDS:
            self.clear()
            new = runs
        plain, odd = apart(" ".join(filter(None, new)))
        if plain:
            self.update(zip(plain.split(" "), b"".join(map(self.pieces.__getitem__, PIECES.findall(plain.lower()))).split(BETWEEN)))
        for run in odd:
            self[run] = np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()
        self[""] = b""  # beside blanks at a text's ends

    def each(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order, with the end id. The different runs of a slice are looked up once."""
        for some in slices(texts):
            split = pc.ascii_split_whitespace(pa.array([t or "" for t in some], pa.string()))
            coded = split.flatten().dictionary_encode()
            runs, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
            self.learn(runs)
            found = [*map(self.__getitem__, runs)]
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            n = size[codes]
            upto = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat((np.cumsum(size) - size)[codes] - upto[:-1], n) + np.arange(upto[-1])
            ids, ends = np.frombuffer(b"".join(found), "<u4")[at], upto[split.offsets.to_numpy()]
            for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
                yield np.concatenate([ids[start:end], ENDED])

    def of(self, text: str | None) -> np.ndarray:
        return next(self.each([text]))


def apart(joined: str) -> tuple[str, list[str]]:
    """Of runs joined by spaces, the plain ones, joined likewise, and the others."""
    kept, odd, at = [], [], 0
    while m := ODD.search(joined, at):
        start, end = max(at, joined.rfind(" ", at, m.start()) + 1), joined.find(" ", m.end())
        end = len(joined) if end < 0 else end
        odd.append(joined[start:end])
        kept.append(joined[at:start])
        at = end + 1
    return "".join([*kept, joined[at:]]).removesuffix(" "), odd


def slices(texts: Iterable[str | None]) -> Iterator[list[str | None]]:
    some, size = [], 0
    for t in texts:
        n = len(t) if t else 0
        if some and size + n > SLICE_CHARS:
            yield some
            some, size = [], 0
        some.append(t)
        size += n
    if some:
        yield some


class Packer:
    """Pieces are (row, start, length); yields sequences, each a list of pieces."""

    def __init__(self, window: int = WINDOW, space: int = OPEN) -> None:
        self.window, self.space, self.open = window, space, []  # [tokens, pieces]

    def add(self, row: object, n: int) -> Iterator[list[tuple]]:
        start = 0
        while n - start >= self.window:
            yield [(row, start, self.window)]
            start += self.window
        while start < n:
            need = n - start
            fits = [x for x in self.open if self.window - x[0] >= need]
            if fits or len(self.open) < self.space:
                if not fits:
                    self.open.append([0, []])
                best = max(fits, key=lambda x: x[0]) if fits else self.open[-1]
                best[0] += need
                best[1].append((row, start, need))
                start = n
            else:
                best = max(self.open, key=lambda x: x[0])
                take = self.window - best[0]
                best[1].append((row, start, take))
                best[0] += take
                start += take
            if best[0] == self.window:
                self.open.remove(best)
                yield best[1]

    def rest(self) -> Iterator[list[tuple]]:
        pieces = [p for x in self.open for p in x[1]]
        total, self.open = sum(p[2] for p in pieces), []
        while total:
            size = self.window if total >= self.window else 1 << total.bit_length() - 1
            total -= size
            out = []
            while size:
                row, start, n = pieces[0]
                take = min(n, size)
                out.append((row, start, take))
                pieces[:1] = [(row, start + take, n - take)] if take < n else []
                size -= take
            yield out


def packed(batches: Iterable[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    ids_of, packer, context = Ids(path), Packer(), TaskContext.get()
    sequence, held, serial = (context.partitionId() if context else 0) << 40, {}, 0

    def rows(pieces: list[tuple]) -> list[tuple]:
        nonlocal sequence
        out, offset = [], 0
        for row, start, n in pieces:
            doc, ids, left = held[row]
            out.append((doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), sequence, offset))
            offset += n
            if left == n:
                del held[row]
            else:
                held[row][2] = left - n
        sequence += 1
        return out

    for pdf in batches:
        done: list[tuple] = []
        for doc, ids in zip(pdf["doc_id"], ids_of.each(pdf["text"])):
            serial += 1
            held[serial] = [None if pd.isna(doc) else int(doc), ids, len(ids)]
            for pieces in packer.add(serial, len(ids)):
                done += rows(pieces)
        yield frame(done, names)
    yield frame([x for pieces in packer.rest() for x in rows(pieces)], names)
    ids_of.pieces.clear()  # the worker lives on
    ids_of.clear()


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({c: "Int64" if c == "doc_id" else "int64" for c in names})


def pack(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(lambda it: packed(it, tokenizer_path), SCHEMA)
