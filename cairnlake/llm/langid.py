"""Language ID with unigram pieces: the probability of a text under a language sums over all its segmentations.

The pieces are all those of a fixed public vocabulary (the longest has ``LONGEST`` characters). Their probabilities by language are
learnt from at most ``PER_LANG`` labelled documents a language outside the held-out fold, in hash order (the documented
sample): first from all occurrences of the pieces, then by ``ROUNDS`` rounds of expectation and maximisation over all
segmentations. A text's words (runs of letters) are scored by the forward algorithm, vectorised over distinct words of
one length; a word's score is kept, so a text costs a look-up a word. Words over ``PART`` characters are scored one by
one, with the last ``LONGEST`` states of the same recursion; only learning takes such words in parts.

Defined cases: null text and texts without a letter are ``und`` with score 0; null doc_id is never learnt from and
counts as held out; without any labelled document everything is ``und``; repeated rows and other columns change nothing.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
PER_LANG = 500
ROUNDS = 2
LONGEST = 16
PART = 32
PRIOR = 0.01
UNKNOWN = 1e-9
CACHE = 300_000
START = "▁"
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Runs of word characters without digits that hold a letter; fractions and other number signs alone make none."""
    return [w for w in WORD.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


class Trie:
    """The vocabulary's pieces; a step from a state by a character is a search in sorted keys."""

    def __init__(self, pieces: Iterable[str]) -> None:
        pieces = sorted({p for p in pieces if 0 < len(p) <= LONGEST})
        self.codes = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        self.width = len(self.codes) + 1
        steps: dict[int, int] = {}
        ends = []
        for p in pieces:
            state = 0
            for c in p:
                state = steps.setdefault(state * self.width + self.codes[c], len(steps) + 1)
            ends.append(state)
        self.states = len(steps) + 1
        self.keys = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.is_piece = np.zeros(self.states, bool)
        self.is_piece[ends] = True

    def next_state(self, state: int, c: str) -> int:
        """0 if no piece goes on with c."""
        key = state * self.width + self.codes.get(c, 0)
        at = int(np.searchsorted(self.keys, key))
        return int(self.next[at]) if at < len(self.keys) and self.keys[at] == key else 0

    def encode(self, parts: list[str]) -> np.ndarray:
        """Parts of one length, as codes; 0 is a character of no piece."""
        return np.array([[self.codes.get(c, 0) for c in p] for p in parts], np.int64)

    def walk(self, codes: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, state of each row's substring from start); dead rows are in state 0."""
        state, live = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
        for n in range(1, min(LONGEST, codes.shape[1] - start) + 1):
            key = state * self.width + codes[:, start + n - 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            live &= self.keys[at] == key
            state = np.where(live, self.next[at], 0)
            yield n, state
            if not live.any():
                return


def parts_of(word: str) -> list[str]:
    word = START + word
    return [word[i : i + PART] for i in range(0, len(word), PART)]


def forward(trie: Trie, codes: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """Sum over the segmentations of every prefix; p is (state, language)."""
    n = codes.shape[1]
    a = [np.zeros((len(codes), p.shape[1])) for _ in range(n + 1)]
    a[0] += 1
    for s in range(n):
        a[s + 1] += a[s] * UNKNOWN
        for size, state in trie.walk(codes, s):
            a[s + size] += a[s] * p[state]
    return a


def forward_long(trie: Trie, word: str, p: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over the segmentations of a long word: the last LONGEST states, scaled as they go."""
    ahead = [np.zeros(p.shape[1]) for _ in range(LONGEST + 1)]
    ahead[0] += 1
    logs = np.zeros(p.shape[1])
    for s in range(len(word)):
        here = ahead.pop(0)
        ahead.append(np.zeros(p.shape[1]))
        ahead[0] += here * UNKNOWN
        state = 0
        for size, c in enumerate(word[s : s + LONGEST]):
            state = trie.next_state(state, c)
            if not state:
                break
            if trie.is_piece[state]:
                ahead[size] += here * p[state]
        scale = np.maximum(ahead[0], 1e-300)
        logs += np.log(scale)
        ahead = [x / scale for x in ahead]
    return logs


def by_length(parts: Iterable[str]) -> dict[int, list[str]]:
    out = defaultdict(list)
    for x in parts:
        out[len(x)].append(x)
    return out


def learn(trie: Trie, counts: Counter) -> np.ndarray:
    """Piece probabilities of one language by trie state."""
    weights: Counter = Counter()
    for word, n in counts.items():
        for part in parts_of(word):
            weights[part] += n
    p = np.zeros(trie.states)
    for round_no in range(ROUNDS + 1):
        expected = np.zeros(trie.states)
        for n, parts in by_length(weights).items():
            codes, w = trie.encode(parts), np.array([weights[x] for x in parts], float)
            if not round_no:
                for s in range(n):
                    for _, state in trie.walk(codes, s):
                        expected += np.bincount(state, w, trie.states)
                continue
            a = [x[:, 0] for x in forward(trie, codes, p[:, None])]
            b = [np.zeros(len(parts)) for _ in range(n + 1)]
            b[n] += 1
            walks = [[(size, state) for size, state in trie.walk(codes, s)] for s in range(n)]
            for s in reversed(range(n)):
                b[s] += b[s + 1] * UNKNOWN
                for size, state in walks[s]:
                    b[s] += p[state] * b[s + size]
            for s in range(n):
                for size, state in walks[s]:
                    expected += np.bincount(state, w * a[s] * p[state] * b[s + size] / a[n], trie.states)
        expected = np.where(trie.is_piece, expected + PRIOR, 0)
        p = expected / expected.sum()
    return p


class Scorer:
    def __init__(self, trie: Trie, langs: list[str], p: np.ndarray) -> None:
        self.trie, self.langs, self.p = trie, langs, p
        self.row: dict[str, int] = {}
        self.used = 0
        self.logs = np.empty((CACHE, len(langs)))

    def add(self, new: set[str]) -> None:
        """Score words not seen before."""
        parts: dict[str, np.ndarray] = {}
        for _, same in by_length({START + w for w in new if len(w) < PART}).items():
            for i in range(0, len(same), 20_000):
                some = same[i : i + 20_000]
                parts.update(zip(some, np.log(np.maximum(forward(self.trie, self.trie.encode(some), self.p)[-1], 1e-300))))
        for w in new:
            at = self.row[w] = self.used
            self.used += 1
            if at >= len(self.logs):
                self.logs = np.concatenate([self.logs, np.empty_like(self.logs)])
            self.logs[at] = parts[START + w] if len(w) < PART else forward_long(self.trie, START + w, self.p)

    def predict(self, text: str | None) -> tuple[str, float]:
        seq = words(text)
        if not seq or not self.langs:
            return "und", 0.0
        total = self.logs[np.fromiter(map(self.row.__getitem__, seq), np.int64, len(seq))].sum(axis=0)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(total - total[best]).sum())

    def batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for i in range(0, len(texts), 500):
            some = texts[i : i + 500]
            if self.used >= CACHE:
                self.row.clear()
                self.used = 0
            new = {w for t in some for w in words(t)}.difference(self.row)
            self.add(new)
            out += [self.predict(t) for t in some]
            for w in new:
                if len(w) >= PART:  # a long run of letters isn't kept
                    del self.row[w]
        return out


def vocabulary(path: str) -> list[str]:
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sample_counts(docs: DataFrame) -> dict[str, Counter]:
    """Word counts by language of the labelled sample: PER_LANG documents a language at most, so bounded."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang").withColumn("at", F.row_number().over(order)).where(F.col("at") <= PER_LANG).select("doc_id").distinct()

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(pdf["lang"], pdf["text"]):
                found[lang].update(words(text))
            yield pd.DataFrame([(g, w, n) for g, c in found.items() for w, n in c.items()], columns=["lang", "word", "n"])

    got = rows.join(chosen, "doc_id", "left_semi").select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, Counter] = defaultdict(Counter)
    for lang, word, n in got.toLocalIterator():
        out[lang][word] = n
    return out


def predict(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    docs = docs.select("doc_id", "text", "lang")
    trie = Trie(vocabulary(vocabulary_path))
    counts = sample_counts(docs)
    langs = sorted(counts)
    p = np.stack([learn(trie, counts[g]) for g in langs], axis=1) if langs else np.zeros((trie.states, 0))
    model = docs.sparkSession.sparkContext.broadcast((trie, langs, p))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*model.value)
        for pdf in batches:
            got = scorer.batch([None if t is None else t for t in pdf["text"]])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": [g for g, _ in got], "score": [s for _, s in got]}).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
