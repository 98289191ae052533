"""Scores of many queries at once: whole results from the best few a task, and what is moved for them."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnlake.functions import text as tx
from cairnlake.operators import lexical, passages
from cairnlake.operators import retrieval as rt
from tests.test_engine import small


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df, *columns) -> list[tuple]:
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("per", [None, 2])
def test_best_of_tasks_holds_the_best_of_all(monkeypatch, per):
    monkeypatch.setattr(lexical, "CELLS", 40)
    rng = random.Random(per)
    pairs = pd.DataFrame([(q, w, rng.randint(1, 2)) for q in range(7) for w in "abcdef" if rng.random() < 0.6], columns=["query_id", "term", "count"])
    known = lexical.index(pairs, list("abcdef"))
    records = [(f"r{i:03}", f"p{rng.randrange(60)}", sorted(rng.sample(range(6), rng.randrange(4)))) for i in range(400)]
    value = np.array([1.0, 0.5, 0.5, 0.25, 2.0, 0.0000004])
    got, want = [], []
    for task in range(5):
        best = lexical.Best(known, ["ref_id"], 9, per)
        for batch in (records[task::5][:50], records[task::5][50:]):
            t = np.array([x for *_, ts in batch for x in ts], np.int64)
            names = pd.DataFrame([r[:2] for r in batch], columns=["ref_id", "parent_id"])
            assert list(best.of(names, t, value[t], np.array([len(r[2]) for r in batch]))) == []
        got += [tuple(x) for f in best.rest() for x in f[["query_id", "score", "ref_id", "parent_id"]].itertuples(index=False)]
    assert max(Counter(q for q, *_ in got).values()) <= 45
    weight = {(q, w): n for q, w, n in pairs.itertuples(index=False)}
    for ref, parent, ts in records:
        for q in range(7):
            if any((q, "abcdef"[t]) in weight for t in ts):
                want.append((q, round(sum(weight.get((q, "abcdef"[t]), 0) * value[t] for t in ts), 6), ref, parent))

    def top(rows):
        out, seen, taken = [], Counter(), Counter()
        for q, s, ref, parent in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
            seen[q, parent] += 1
            if (not per or seen[q, parent] <= per) and taken[q] < 9:
                taken[q] += 1
                out.append((q, s, ref))
        return out

    assert top(got) == top(want)


def test_rounds_as_spark(spark):
    x = [0.1234565, 0.12345649999999, 2.5e-7, 5e-7, 4.999999e-7, 1.0000005, 123.4567885, 0.0, 7.0000015]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()] == lexical.rounded(np.array(x)).tolist()


def test_session_views_send_their_best(spark):
    """a row a view is written, and no task sends more than the best of a query, however many views hold its words."""
    m = spark.range(0, 900, 1, 3).select((F.col("id") % 7).cast("string").alias("session"), F.col("id").alias("position"), F.format_string("r%03d", "id").alias("ref_id"), F.when(F.col("id") % 50 == 0, "the fox ran").otherwise("the dog ran").alias("body"))
    terms = spark.createDataFrame([(q, t) for q in range(4) for t in ("the", "fox", "an", "ran")[: q + 1]], "query_id long, term string")
    few, every = rt.session_view_channel(m, terms, 5), rt.session_view_channel(m, terms)
    order = ["query_id", "ref_id", "score", "rank"]
    assert rows_of(rt.ranked(few, 5), *order) == rows_of(rt.ranked(every, 5), *order)
    assert every.count() == 4 * 900 and few.count() <= 5 * 4 * few.rdd.getNumPartitions() < 900
    assert "HashAggregate" not in plan(few) and "Join" not in plan(few)


def test_automata_in_passes(spark, monkeypatch):
    recs = small(spark)
    terms = spark.createDataFrame([(1, t) for t in ("fox", "dog", "o", "zz", "the", "alpha")], "query_id long, term string")
    whole, bm = rows_of(rt.substring_channel(recs, terms), "ref_id", "score"), rows_of(rt.bm25_channel(recs, terms), "ref_id", "score")
    monkeypatch.setattr(lexical, "AUTOMATON_TERMS", 2)
    hits = rt.lexical_hits(recs, terms)
    assert hits.rows.count() == 3 and rows_of(rt.substring_channel(recs, terms, hits), "ref_id", "score") == whole and rows_of(rt.bm25_channel(recs, terms, hits=hits), "ref_id", "score") == bm
    none = terms.limit(0)
    assert rt.substring_channel(recs, none).count() == rt.bm25_channel(recs, none, most=3).count() == rt.substring_channel(recs.limit(0), terms, most=3).count() == 0


def test_term_cosine(spark):
    """against all pairs; the texts' features are not moved."""
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["Ab", "ab", "w:", "a.b-c", "日本", "x  y", "\t", " é", "😀z"]) for _ in range(rng.randrange(9)))
    docs = [(f"d{i:02}", None if i == 3 else text()) for i in range(60)] + [(f"e{i:02}", "ab ab") for i in range(20)]
    asked = [(1, "ab x"), (2, "w: 😀z"), (3, None), (4, ""), (5, "q"), (6, "日本 a.b-c")]

    def bag(s):
        plain = re.sub(r"[ \t\n\x0b\f\r]+", "", s.lower())
        return Counter([plain[i : i + 2] for i in range(len(plain) - 1)] + re.findall(r"[a-z0-9._-]{2,}", s.lower()))

    norm = lambda c: math.sqrt(sum(v * v for v in c.values()))
    want = []
    for q, query in asked:
        scored = [(-round(sum(bag(query)[t] * n for t, n in b.items()) / (norm(bag(query)) * norm(b)), 6), d) for d, s in docs if query and s and (b := bag(s)).keys() & bag(query).keys()]
        want += [(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(scored)[:5])]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    got = rt.term_cosine(queries, spark.createDataFrame(docs, "source_id string, body string").repartition(3))
    assert rows_of(got, "query_id", "source_id", "score", "position") == sorted(want)
    assert not any(x in plan(got) for x in ("Generate", "HashAggregate", "Join"))
    assert rt.term_cosine(queries.limit(0), spark.createDataFrame(docs, "source_id string, body string")).count() == 0


def test_passage_search(spark):
    """against scores of all passages; the passages are split once, and none is joined with its place."""
    body = lambda i: "\n\n".join(f"the {'fox' if (i + j) % 3 else 'dog'} of {i % 5} " + "x" * 400 for j in range(i % 6))
    recs = spark.createDataFrame([("event", f"r{i:02}", "t", ["x"], body(i)) for i in range(60)], "record_type string, ref_id string, title string, tags array<string>, body string").repartition(4)
    queries = spark.createDataFrame([(1, "fox the"), (2, "dog of"), (3, "nothing")], "query_id long, query string")
    parts = passages.split(recs.select(F.col("ref_id").alias("parent_id"), "body"))
    rows = parts.select(F.lit("passage").alias("record_type"), F.col("passage_id").alias("ref_id"), F.lit("").alias("title"), F.array().cast("array<string>").alias("tags"), F.col("text").alias("body"))
    hits = rt.substring_channel(rows, rt.query_terms(queries, tx.lexical_terms(F.col("query")))).select("query_id", F.col("ref_id").alias("passage_id"), "score")
    every = passages.group_to_parents(passages.per_parent(hits.join(parts.select("parent_id", "passage_id", "start", "end"), "passage_id")))
    got = passages.search(queries, recs, limit=60)
    assert rows_of(got, "query_id", "parent_id", "score", "spans") == rows_of(every, "query_id", "parent_id", "score", "spans") and got.count() > 50
    assert "Join" not in plan(got)


def test_fields_without_hits_are_not_written(spark, monkeypatch):
    """no zeros for titles and tags that passages don't have; scores of records with some fields against their formula."""
    rng = random.Random(5)
    words = ["fox", "ox", "dog", "the"]
    say = lambda: " ".join(rng.choice([*words, "zz"]) for _ in range(rng.randrange(4)))
    made = [("event", f"r{i:02}", say(), [say()], say()) for i in range(80)]
    recs = spark.createDataFrame(made, "record_type string, ref_id string, title string, tags array<string>, body string").repartition(3)
    terms = spark.createDataFrame([(1, w) for w in words], "query_id long, term string")
    df = {w: sum(any(w in f for f in (t, g[0], b)) for _, _, t, g, b in made) for w in words}
    want = [(r, round(sum(math.log(1 + 81 / (df[w] + 1)) * len(w) * sum(x * (w in f) for x, f in zip(rt.FIELD_BOOSTS, (t, g[0], b))) for w in words), 6)) for _, r, t, g, b in made]
    for most in (200_000, 2):
        monkeypatch.setattr(lexical, "AUTOMATON_TERMS", most)
        assert dict(rows_of(rt.substring_channel(recs, terms), "ref_id", "score")) == pytest.approx({r: x for r, x in want if x})
    monkeypatch.setattr(lexical, "AUTOMATON_TERMS", 200_000)
    parts = lexical.hits(recs.select(F.col("ref_id").alias("parent_id"), "body"), terms, passages.unfolded, passages.UNFOLDED).rows
    sums = parts.agg(*[F.sum(F.size(c)) for c in ("t", *lexical.COUNTS)]).first()
    assert sums[0] == sums[3] > 0 and sums[1] == sums[2] == 0


def test_expansions_share_the_texts(spark, monkeypatch):
    """one pass over the texts for all channels of the expansions, the best 80 of each from every task."""
    recs = spark.range(0, 500, 1, 3).select(F.lit("event").alias("record_type"), F.format_string("r%03d", "id").alias("ref_id"), F.lit("t").alias("title"), F.array(F.lit("en")).alias("tags"), F.concat(F.lit("i remember "), F.when(F.col("id") % 3 == 0, "foxes").otherwise("dogs")).alias("body"))
    qs = spark.createDataFrame([(1, "fox"), (2, "dogs")], "query_id long, query string")
    extra = qs.select("query_id", tx.recall_template(F.col("query")).alias("expansion"))
    every = rt.expansions(qs, extra, recs)
    passes = []
    monkeypatch.setattr(rt, "lexical_hits", lambda *a, f=rt.lexical_hits: passes.append(a) or f(*a))
    few = rt.expansions(qs, extra, recs, most=rt.CUT)
    assert len(passes) == 1
    assert rows_of(rt.fuse(few), "query_id", "ref_id", "fused", "reasons") == rows_of(rt.fuse(every), "query_id", "ref_id", "fused", "reasons")
    assert every[1].count() == 1000 and few[1].count() <= 2 * rt.CUT * few[1].rdd.getNumPartitions() < 1000
    assert not any("Join" in plan(c) or "HashAggregate" in plan(c) for c in few)


@pytest.mark.parametrize("most", [200_000, 1])
def test_found_go_to_their_records(spark, monkeypatch, most):
    """the found go to the texts; beyond a counted bound both are shuffled, with the same result."""
    monkeypatch.setattr(rt, "BROADCAST_HITS", most)
    found = spark.createDataFrame([(q, f"r{q + i}", i) for q in range(3) for i in range(4)], "query_id long, ref_id string, position int")
    recs = spark.range(0, 50).select(F.format_string("r%d", "id").alias("ref_id"), F.col("id").cast("string").alias("body"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rt.with_records(found, recs, ["ref_id"])
        assert ("BroadcastHashJoin" in plan(got)) == (most > 1)
        assert rows_of(got, "query_id", "position", "body") == sorted((q, i, str(q + i)) for q in range(3) for i in range(4))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
