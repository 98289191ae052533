"""Small tables with everything that is awkward, and brute-force versions of the operators."""

import collections
import random
import re

LONG = " ".join(f"long{i % 977}" for i in range(30_000))
EXTRA = {"row": "x", "node": 1, "k": 2, "n": 3, "cell": 4, "blob": "b", "bucket": 5, "lines": "l", "q": "q", "t": "t", "kept": "no", "seed": 9, "component": 7}


def vocabulary(rng, n=400):
    return ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def texts(seed=0, n=60):
    """Distinct texts, exact copies, near copies, shared lines and shared passages."""
    rng = random.Random(seed)
    words = vocabulary(rng)
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared_line, passage = "  The Common line of all the many documents here  ", say(40)
    out = []
    for i in range(n):
        body = [say(rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            body.insert(rng.randint(0, len(body)), shared_line if i % 8 else shared_line.strip().upper())
        if i % 5 == 0:
            body.insert(rng.randint(0, len(body)), passage)
        out.append("\n".join(body))
    for i in range(0, n, 6):
        out.append(out[i])
        near = out[i].split(" ")
        near[rng.randrange(len(near))] = "changed"
        out.append(" ".join(near))
    return out


def documents(spark, extra=False, awkward=True, seed=0, n=60):
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts(seed, n))]
    if awkward:
        at = len(rows)
        rows += [(at, None, None, None, None), (at + 1, "", "en", "s", 0), (at + 2, " \n\t", "xx", "s", 3), (at + 3, LONG, "en", "s", len(LONG)), (at + 4, "one", None, "s", 3), (at + 5, "naïve 😀 ÀÉ\x0bx" * 9, "fr", "s", 99)]
        rows += [rows[0], rows[0], (None, rows[1][1], "en", "s", 5), (at + 6, "a\x00b" * 40, "de", "s", 120), (at + 7, "z\x00" + rows[2][1], "de", "s", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    if extra:
        from pyspark.sql import functions as F

        for c, v in EXTRA.items():
            df = df.withColumn(c, F.lit(v))
    return df


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def grams(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(rows, n, percent):
    """doc_id -> (component, sizes of its rows)"""
    by = collections.defaultdict(list)
    for d, t in rows:
        by[d].append(grams(t, n))
    ids = [d for d in by if d is not None]
    up = {d: d for d in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in by[a] for y in by[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {d: top(d) for d in ids}


def base_spans(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def covered(rows, match=50):
    """(doc_id, text) -> removed mask: bytes under a window that starts in a document with a smaller doc_id too."""
    low = {}
    for d, t in rows:
        if d is not None:
            raw = (t or "").encode()
            for i in range(len(raw) - match + 1):
                w = raw[i : i + match]
                low[w] = min(low.get(w, d), d)
    out = {}
    for d, t in rows:
        raw = (t or "").encode()
        mask = bytearray(len(raw))
        if d is not None:
            for i in range(len(raw) - match + 1):
                if low[raw[i : i + match]] < d:
                    mask[i : i + match] = b"\1" * match
        out[d, t] = mask
    return out
