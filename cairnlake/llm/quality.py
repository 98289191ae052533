"""Quality rules: base counts and the divergence of a document's histograms from its language's.

Method: every document gets two histograms, one over character classes and one over the common words of its
language (and "any other word"). The references are the sums of these histograms over all documents of the language
that pass the base rules. A document is rejected where the Jensen-Shannon distance (square root of the divergence to
base 2, 0 to 1) to its reference exceeds a limit, unless the histogram has too few characters or words to mean anything.

Defined cases: null text has no words, so base_failed; null or unlisted lang is held against the pooled reference
OTHER; other columns are passed on by ``keep`` alone; repeated rows are judged one by one; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

# Frequent function words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er aus bei einer",
    "en": "the of and to in a is that for it as was with be by on not he this are or from at which an his have had they",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le es o",
    "fr": "de la le et les des en un du une est que pour qui dans par plus pas au sur ne se ce il sont avec son aux",
}
OTHER = "other"
MIN_WORDS = 50
MIN_CHARS_JS = 2 * MIN_WORDS - 1  # the fewest characters of MIN_WORDS words, blanks included
MIN_WORDS_JS = 80
#: Rows of a batch that are worked on at once.
SLICE = 500
MAX_CHAR_JS = 0.25
MAX_WORD_JS = 0.29

SYMBOLS = b"#*$%&|<>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def _classes() -> np.ndarray:
    """byte -> character class; a multi-byte character counts by its first byte."""
    c = np.full(256, 7, np.int64)
    c[list(range(97, 123))] = 0
    c[list(range(65, 91))] = 1
    c[list(range(48, 58))] = 2
    c[list(b".,;:!?'\"()-")] = 3
    c[list(SYMBOLS)] = 4
    c[list(SPACE)] = 5
    c[0xC0:] = 6
    c[0x80:0xC0] = 8  # continuation: counted nowhere
    return c


CLASSES, N_CLASSES = _classes(), 8
INDEX = {lang: {w.encode(): i for i, w in enumerate(s.split())} for lang, s in COMMON.items()}
POOLED = {w: i for i, w in enumerate(sorted({w for ws in INDEX.values() for w in ws}))}
WIDTH = len(POOLED) + 1

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
HISTOGRAMS = ("chars", "common")
FEATURES = T.StructType([T.StructField(x, T.LongType()) for x in COUNTS] + [T.StructField(x, T.ArrayType(T.LongType())) for x in HISTOGRAMS])


def repeated_words(seq: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(seq) - 2
    if n < 2:
        return 0
    windows = list(zip(seq, seq[1:], seq[2:]))
    if len(set(windows)) == n:
        return 0
    ids: dict[tuple, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in windows), np.int64, n)
    hit = np.bincount(at)[at] > 1
    covered = np.zeros(n + 2, bool)
    for i in range(3):
        covered[i : n + i] |= hit
    return int(covered.sum())


def measure(text: str | None, lang: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    seq = raw.split()
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = np.bincount(CLASSES, bins, 9).astype(np.int64)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    index = INDEX.get(lang, POOLED)
    common = [0] * WIDTH
    low = raw.lower().split()
    for w in low:
        common[index.get(w, -1)] += 1
    return (
        len(seq),
        int(chars[:8].sum() - chars[5]),
        int(sum(bins[c] for c in SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(seq),
        chars[:N_CLASSES].tolist(),
        common,
    )


def measures(batch: pa.RecordBatch) -> pa.StructArray:
    """The measures of each row's text, one text in Python at a time."""
    at = batch.schema.names.index
    columns = list(zip(*[measure(text.as_py(), lang.as_py()) for text, lang in zip(batch.column(at("text")), batch.column(at("lang")))]))
    kinds = [pa.int64()] * len(COUNTS) + [pa.list_(pa.int64())] * len(HISTOGRAMS)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], FEATURES.names)


def with_measures(docs: DataFrame, name: str, without: str = "") -> DataFrame:
    """The rows with their measures as a struct; one row in, one row out. A column can be left behind."""
    columns = [c for c in docs.columns if c != without]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [batch.schema.names.index(c) for c in columns]
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in at], measures(part)], [*columns, name])

    return docs.mapInArrow(run, T.StructType([f for f in docs.schema.fields if f.name != without] + [T.StructField(name, FEATURES)]))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 50 * n_words


def references(measured: DataFrame, name: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """language -> (character classes, common words) summed over its documents that pass the base rules.

    One row for each listed language and OTHER comes to the driver, no more.
    """
    lang = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise(F.lit(OTHER)).alias("ref")
    m = F.col(name)
    sums = [F.sum(m["chars"][i]).alias(f"c{i}") for i in range(N_CLASSES)] + [F.sum(m["common"][i]).alias(f"w{i}") for i in range(WIDTH)]
    sound = measured.where((m["n_words"] >= MIN_WORDS) & (100 * m["n_repeat_words"] <= 50 * m["n_words"]))
    return {r[0]: (np.array(r[1 : 1 + N_CLASSES], float), np.array(r[1 + N_CLASSES :], float)) for r in sound.groupBy(lang).agg(*sums).collect()}


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 where either is empty."""
    if not a.sum() or not b.sum():
        return 0.0
    a, b = a / a.sum(), b / b.sum()
    m = (a + b) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return max(0.0, (part(a) + part(b)) / 2) ** 0.5


def judge(m: Sequence, lang: str | None, refs: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[bool, bool, float, float]:
    """(base_failed, kept, char_js, word_js) of measures; the one verdict of the query and of the pipeline."""
    failed = base_failed(m[0], m[4])
    ref = refs.get(lang if lang in COMMON else OTHER)
    char_js, word_js = (distance(np.array(x, float), r) for x, r in zip(m[5:7], ref)) if ref else (0.0, 0.0)
    strange = (sum(m[5]) >= MIN_CHARS_JS and char_js > MAX_CHAR_JS) or (m[0] >= MIN_WORDS_JS and word_js > MAX_WORD_JS)
    return failed, not failed and not strange, char_js, word_js


def verdict(refs: dict[str, tuple[np.ndarray, np.ndarray]]) -> Callable[[Column, Column], Column]:
    """(measures, lang) -> base_failed, kept, char_js, word_js; only measures go to Python."""

    @F.pandas_udf("base_failed boolean, kept boolean, char_js double, word_js double")
    def told(m: pd.DataFrame, lang: pd.Series) -> pd.DataFrame:
        rows = [judge(x, g, refs) for *x, g in zip(*[m[c] for c in FEATURES.names], lang)]
        return pd.DataFrame(rows, columns=["base_failed", "kept", "char_js", "word_js"]).round(6)

    return told


def quality(docs: DataFrame) -> DataFrame:
    """One row per document with the base counts, the verdict and the distances."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    rows = cut(with_measures(slim, "m", without="text"), "quality")
    told = rows.withColumn("v", verdict(references(rows, "m"))(F.col("m"), F.col("lang")))
    return told.select("doc_id", *[f"m.{c}" for c in COUNTS], "v.base_failed", "v.kept", "v.char_js", "v.word_js")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns.

    Texts are measured once, as the documents are written with their measures; no document is shuffled: the references
    are a few rows.
    """
    name = "m" + "_" * max(map(len, docs.columns))
    rows = cut(with_measures(docs, name), "quality")
    told = verdict(references(rows, name))(F.col(name), F.col("lang"))
    return rows.where(told["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
