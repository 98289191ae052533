"""The engine's own operators on hand-made rows: bitemporal state, chains, lineage, ranking, passages, packing, dates."""

import hashlib
import math
import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.functions import temporal as tm
from cairnlake.functions import text as tx
from cairnlake.operators import context, evaluation, memory, passages, reports
from cairnlake.operators import retrieval as rt
from cairnlake.sources import events as ev

DAY = lambda n: datetime(2024, 1, n)


def one(spark, column, **values):
    kinds = {str: "string", int: "long", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


# -- text


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("Hello, hello v1.2 x", ["hello", "v1.2"]),
        ("数据库迁移怎么做", ["数据库迁移", "数据库", "据库迁", "库迁移", "数据", "据库", "库迁", "迁移"]),
        ("什么", []),
        ("", []),
    ],
)
def test_lexical_terms(spark, query, want):
    assert one(spark, tx.lexical_terms(F.col("q")), q=query) == want


def test_features_and_vector(spark):
    text = "Ab  cd数据 éx"
    plain = re.sub(r"\s+", " ", text.lower()).strip()
    compact = plain.replace(" ", "")
    want = [compact[i : i + n] for n in (2, 3) for i in range(len(compact) - n + 1)] + ["w:" + t for t in re.findall(tx.TERM, plain)]
    assert one(spark, tx.features(F.col("t")), t=text) == want
    v = np.zeros(512)
    for f in want:
        h = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
        v[h % 512] += -1 if h >> 63 else 1
    got = np.array(one(spark, tx.hashed_vector(F.col("t")), t=text))
    assert np.allclose(got, v / np.linalg.norm(v), atol=1e-6)
    assert sum(abs(x) for x in one(spark, tx.hashed_vector(F.col("t")), t="")) == 0


def test_entities_and_tags(spark):
    assert one(spark, tx.entities(F.col("t")), t="The Alice Smith met Bob. ALICE smith and alice; The Bob Bob, Alice Smith") == ["The Alice Smith", "Bob", "ALICE", "The Bob Bob", "Alice Smith"]
    assert one(spark, tx.distinct_tags(F.col("t")), t=[" A", "a", "", "b "]) == ["A", "b"]
    assert one(spark, tx.searchable_tags(F.col("t")), t=["AML-session:x", "y"]) == ["y"]


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("sk-" + "a" * 16, True), ("sk-short", False), ("ghp_" + "A" * 16, True), ("AKIA" + "B" * 16, True), ("AKIA" + "B" * 15, False), ("api_key = abcdef", True), ("cookie: abc", False),
        ("eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 8, True), ("-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY-----", True), ("-----BEGIN RSA PRIVATE KEY-----", False), ("plain text", False),
    ],
)
def test_secrets(spark, text, hit):
    assert one(spark, tx.has_secret(F.col("t")), t=text) is hit


def test_clip():
    assert tx.clip_text("aé😀b", 3) == "aé" and tx.clip_text("aé😀b", 4) == "aé" and tx.clip_text("abcdef", 5, True) == "ab…" and tx.clip_text("x", 0) == ""


def test_overlapping_occurrences(spark):
    assert one(spark, rt.occurrences(F.col("t"), F.col("s")), t="aaaa.b.b", s="aa") == 3
    assert one(spark, rt.occurrences(F.col("t"), F.col("s")), t="a.b a.b axb", s="a.b") == 2


# -- dates


@pytest.mark.parametrize(
    ("query", "as_of"),
    [
        ("as of March 2026", "2026-03-31T23:59:59.999999Z"), ("as of 2023-05-04", "2023-05-04T23:59:59.999999Z"), ("before 2023-05-04", "2023-05-04T00:00:00.000000Z"), ("since May 2020", None),
        ("in winter 2022", "2022-02-28T23:59:59.999999Z"), ("second half of February 2024", "2024-02-29T23:59:59.999999Z"), ("first half of May 2021", "2021-05-15T23:59:59.999999Z"), ("截至2026年3月", "2026-03-31T23:59:59.999999Z"),
        ("2026年3月2日之前", "2026-03-02T00:00:00.000000Z"), ("in 2026-13-45", "2026-12-31T23:59:59.999999Z"), ("on 2026-13-45", None), ("by March 31st, 2020", "2020-03-31T00:00:00.000000Z"), ("during February 30 2020", None), ("hello", None), ("between August and November 2023", "2023-11-30T23:59:59.999999Z"),
    ],
)
def test_intent(query, as_of):
    assert tm.intent_of(query, tm.utc(2024, 2, 1))[1] == as_of


def test_relative_intent():
    got = tm.intent_of("what did we say last week, as we used to", tm.utc(2024, 2, 1))
    assert got == (True, None, True, "last week", "2024-01-28T23:59:59.999999Z", "")


def test_date_tags():
    assert tm.date_tags_of("On 11 August 2023 and 2026-13-45, in autumn 2021; March 2020, 1999") == [
        "2023-08-11", "August 11, 2023", "August 2023", "summer 2023", "2023", "fall 2021", "autumn 2021", "2021", "March 2020", "2020-03", "spring 2020", "2020", "1999",
    ]
    assert tm.date_tags_of("February 30, 2020") == [] and tm.date_tags_of("May 5") == ["May 5"] and tm.date_tags_of(None) == []


# -- memory


def log(spark):
    base = dict(project_id="p", scope="project", scope_id="p", title="t", tags=["x"], body="b", kind="fact", source_event_id="", idempotency_key="", operation="", target_id="", status="active", fact_key="k", valid_to=None, expires_at=None, supersedes=None)
    rows = [
        dict(event_id="e1", fact_id="f1", recorded_at=DAY(1), valid_from=DAY(1)), dict(event_id="e2", fact_id="f2", recorded_at=DAY(2), valid_from=DAY(10), supersedes="f1"), dict(event_id="e3", fact_id="f3", recorded_at=DAY(3), valid_from=DAY(3), fact_key="gone", status="retracted"),
        dict(event_id="e4", fact_id="f4", recorded_at=DAY(4), valid_from=DAY(4), fact_key="old", expires_at=DAY(5)), dict(event_id="e5", fact_id=None, recorded_at=DAY(5), valid_from=DAY(5), kind="episode"),
        dict(event_id="e6", fact_id=None, recorded_at=DAY(6), valid_from=DAY(6), kind="episode", source_event_id="e3"), dict(event_id="e7", fact_id=None, recorded_at=DAY(6), valid_from=DAY(6), kind="episode", source_event_id="e8"), dict(event_id="e8", fact_id=None, recorded_at=DAY(6), valid_from=DAY(6), kind="episode", source_event_id="e7"),
        dict(event_id="e9", fact_id=None, recorded_at=DAY(6), valid_from=DAY(6), kind="episode", source_event_id="missing"), dict(event_id="e10", fact_id=None, recorded_at=DAY(7), valid_from=DAY(7), kind="episode", source_event_id="e5"),
    ]
    schema = "event_id string, project_id string, scope string, scope_id string, kind string, title string, tags array<string>, body string, source_event_id string, idempotency_key string, operation string, target_id string, status string, fact_id string, fact_key string, valid_from timestamp, valid_to timestamp, expires_at timestamp, supersedes string, recorded_at timestamp"
    names = [x.split()[0] for x in schema.split(", ")]
    df = spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], schema)
    events = df.withColumn("status", F.lit("active")).withColumn("observed_at", F.col("recorded_at"))
    facts = memory.derive_facts(df.where("fact_id IS NOT NULL").withColumn("assertion_event_id", F.col("event_id")).withColumn("source_event_id", F.col("event_id")))
    return events, facts


def test_eligible(spark):
    events, facts = log(spark)
    seen = lambda **how: {r.ref_id for r in memory.eligible(events, facts, "p", "project", "p", how.pop("now"), **how).collect()}
    day = lambda n: F.lit(DAY(n)).cast("timestamp")
    assert {r.fact_id: r.status for r in facts.collect()} == {"f1": "superseded", "f2": "active", "f3": "retracted", "f4": "active"}
    assert seen(now=day(8)) == {"f1", "e5", "e10"}  # the successor isn't valid yet; chains to retracted, cyclic and missing sources fall
    assert seen(now=day(10)) == {"f2", "e5", "e10"}  # half-open: closed at its end
    assert seen(now=day(12), soft=True) == {"f1", "f2", "e5", "e10"}
    assert seen(now=day(12), at=day(8)) == {"f1", "e5", "e10"}
    assert seen(now=day(12), view="history") == {"f1", "f2", "f4", "e5", "e10"}
    assert seen(now=day(12), view="history", at=day(4)) == {"f1"}  # expiry still holds in the chain check
    assert seen(now=day(8), known=day(1)) == {"f1"}


def reach(start, edges):
    seen, todo = set(start), list(start)
    while todo:
        x = todo.pop()
        for a, b in edges:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def closed(spark, start, edges):
    ids = spark.createDataFrame([(x,) for x in start], "id string")
    return [r.id for r in memory.closure(ids, spark.createDataFrame(edges, "src string, dst string"), "id").collect()]


@pytest.mark.parametrize("bound", [None, 3])
def test_closure(spark, monkeypatch, bound):
    """A chain, diamonds, a cycle of two, a self-loop, nulls, unreachable ids: in one task and by rounds of joins."""
    if bound:
        monkeypatch.setattr(memory, "WALK_EDGES", bound)
    n = 5 if bound else 500
    chain = [(f"c{i}", f"c{i + 1}") for i in range(n)]
    diamonds = [e for i in range(4 if bound else 30) for e in ((f"d{i}", f"x{i}"), (f"d{i}", f"y{i}"), (f"x{i}", f"d{i + 1}"), (f"y{i}", f"d{i + 1}"))]
    edges = chain + diamonds + [("a", "b"), ("b", "a"), ("s", "s"), ("u", "v"), ("c0", "c1")]
    start = ["c0", "d0", "a", "s", "alone"]
    got = closed(spark, start, edges + [(None, "c0"), ("c0", None)])
    assert set(got) == reach(start, edges) and len(got) == len(set(got))
    assert closed(spark, start, []) and closed(spark, [], edges) == []


def test_closure_of_a_wide_graph(spark):
    from pyspark.sql import functions as F

    edges = spark.range(2_000_000).select(F.lit("hub").alias("src"), F.col("id").cast("string").alias("dst"))
    assert memory.closure(spark.createDataFrame([("hub",)], "id string"), edges, "id").count() == 2_000_001


def test_rebuild_stays_in_its_project(spark):
    """A retraction takes what was derived from its target, and nothing of the same name elsewhere."""
    rows = [("a1", "p", "e", "", None, None), ("a2", "p", "e", "a1", None, None), ("b1", "q", "e", "a1", None, None), ("r1", "p", "e", "", "retract", "a1"), ("r2", "q", "e", "", "retract", "a1")]
    log = [(e, p, "global", p, k, e, "", "", f"2024-01-0{i + 1} 00:00:00", f"2024-01-0{i + 1} 00:00:00", s, f"key-{e}", o, t) for i, (e, p, k, s, o, t) in enumerate(rows)]
    names = "event_id project_id scope scope_id kind title tags body observed_at recorded_at source_event_id idempotency_key operation target_id".split()
    df = spark.createDataFrame(log, ", ".join(f"{n} string" for n in names))
    for c in ("observed_at", "recorded_at"):
        df = df.withColumn(c, df[c].cast("timestamp"))
    for c, t in (("fact_id", "string"), ("fact_key", "string"), ("value_json", "string"), ("asserted_status", "string"), ("valid_from", "timestamp"), ("valid_to", "timestamp"), ("expires_at", "timestamp"), ("supersedes", "string"), ("confidence", "double")):
        df = df.selectExpr("*", f"CAST(NULL AS {t}) AS {c}")
    events, _ = memory.rebuild(df, df["recorded_at"])
    assert {r.event_id: r.status for r in events.collect()} == {"a1": "retracted", "a2": "retracted", "b1": "active", "r1": "active", "r2": "active"}


def test_lineage_and_retraction(spark):
    events, facts = log(spark)
    gone = memory.lineage(events, facts, "p", "e5")
    assert {r.event_id for r in gone.collect()} == {"e5", "e10"}
    assert {r.event_id for r in memory.lineage(events, facts, "p", "f3").collect()} == {"e3", "e6"}
    assert memory.lineage(events, facts, "other", "e5").count() == 0
    after, _ = memory.retract(events, facts, gone)
    assert {r.event_id for r in after.where("status = 'retracted'").collect()} == {"e5", "e10"}
    assert {r.event_id for r in memory.superseded_derivations(events, facts, "p", "f3").collect()} == {"e6"}


def test_candidate_siblings_fall_together(spark):
    events, facts = log(spark)
    keyed = events.withColumn("idempotency_key", F.when(F.col("event_id") == "e5", "candidate-summary:c").when(F.col("event_id") == "e9", "candidate-fact:c:1").otherwise(""))
    assert {r.event_id for r in memory.lineage(keyed, facts, "p", "e9").collect()} == {"e5", "e9", "e10"}


def test_first_write_and_batches(spark):
    df = spark.createDataFrame([("p", "k", 2, "b", "x"), ("p", "k", 1, "a", "x"), ("p", "", 3, "c", None), ("p", "", 3, "d", "y")], "project_id string, idempotency_key string, recorded_at int, event_id string, batch_id string")
    assert {r.event_id for r in memory.first_write(df).collect()} == {"a", "c", "d"}
    marker = spark.createDataFrame([("x", ["a"])], "batch_id string, event_ids array<string>")
    assert {r.event_id for r in memory.committed(df, marker).collect()} == {"a", "c"}


def test_decisions(spark):
    fact = "array<struct<fact_key:string,value:string,title:string,bound:boolean>>"
    rows = [("s", "episode", [], False), ("", "episode", [], False), ("s", "procedure", [], False), ("s", "episode", [("k", "deploy now", "", False)], False), ("s", "episode", [("k", "deploy now", "", True)], False), ("s", "episode", [("", "v", "", False)], False)]
    got = [r.state for r in memory.decide(spark.createDataFrame(rows, f"summary string, kind string, facts {fact}, evidence_valid boolean")).collect()]
    assert got == ["validated", "rejected", "needs_confirmation", "needs_confirmation", "validated", "rejected"]


def test_entities_resolve(spark):
    rows = [("p", "e1", "Ada ", "", ["A"], "mentions", 1), ("p", "e2", "Bob", "person", ["a"], "mentions", 2), ("p", "e2", " ", "x", [], "mentions", 2)]
    ents, aliases, links = memory.resolve_entities(spark.createDataFrame(rows, "project_id string, event_id string, name string, type string, aliases array<string>, relation string, recorded_at int"))
    names = {r.entity_id: (r.name, r.type) for r in ents.collect()}
    assert set(names.values()) == {("Ada", "concept"), ("Bob", "person")}
    assert {r.alias: names[r.entity_id][0] for r in aliases.collect()} == {"ada": "Ada", "bob": "Bob", "a": "Bob"} and links.count() == 2


# -- ranking


def small(spark):
    rows = [("event", "1", "alpha", ["x"], "the quick brown fox", "episode"), ("event", "2", "beta", ["fox"], "lazy dog dog", "core"), ("fact", "3", "fox news", [], "nothing here", "fact")]
    return spark.createDataFrame(rows, "record_type string, ref_id string, title string, tags array<string>, body string, kind string")


def test_substring_and_bm25(spark):
    recs, qs = small(spark), spark.createDataFrame([(1, "fox dog")], "query_id long, query string")
    terms = rt.query_terms(qs, tx.lexical_terms(F.col("query")))
    texts = {r.ref_id: (r.title.lower(), " ".join(r.tags).lower(), r.body.lower()) for r in recs.collect()}
    got = {r.ref_id: r.score for r in rt.substring_channel(recs, terms).collect()}
    df = {t: sum(any(t in f for f in x) for x in texts.values()) for t in ("fox", "dog")}
    want = {k: sum(math.log(1 + 4 / (df[t] + 1)) * 3 * sum(b for b, f in zip((5, 3, 1), x) if t in f) for t in df) for k, x in texts.items()}
    assert got == {k: round(v, 6) for k, v in want.items() if v}
    length = {k: sum(max(0, len(f) - 2) for f in x) for k, x in texts.items()}
    avg = sum(length.values()) / 3
    bm = {}
    for k, x in texts.items():
        for t in df:
            f = sum(w * len(re.findall(f"(?={t})", field)) for w, field in zip((8, 4, 1), x))
            idf = math.log((3 - df[t] + 0.5) / (df[t] + 0.5))
            bm[k] = bm.get(k, 0) + (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[k] / avg))
    assert {r.ref_id: r.score for r in rt.bm25_channel(recs, terms).collect()} == {k: round(v, 6) for k, v in bm.items() if v}
    hits = rt.search(qs, recs)
    assert [r.position for r in hits.orderBy("position").collect()] == [1, 2, 3] and hits.orderBy("position").first().ref_id == "3"


def test_greedy_orders():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(12, 5))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rel = np.sort(rng.random(12))[::-1]
    order = rt.mmr_order(rel, v, 4)
    assert sorted(order) == list(range(12)) and order[0] == 0 and order[4:] == sorted(order[4:])
    chosen, left = [], list(range(12))
    while len(chosen) < 4:
        best = max(left, key=lambda i: (0.7 * rel[i] / rel[0] - 0.3 * max([0.0, *(float(v[i] @ v[j]) for j in chosen)]), -i))
        chosen.append(best)
        left.remove(best)
    assert order == chosen + left
    assert rt.coverage_order(np.array([0.5, 0.499, 0.3]), [{"a"}, {"b"}, {"a", "b"}], {"a": 1.0, "b": 3.0}, 3) == [1, 0, 2]


def test_alias_and_entity_expansion(spark):
    qs = spark.createDataFrame([(1, "ask bob about it"), (2, "bobby"), (3, "老王在吗")], "query_id long, query string")
    al = spark.createDataFrame([("bob", "Robert"), ("老王", "Wang")], "alias string, canonical_name string")
    assert {r.query_id: r.expanded for r in rt.alias_expand(qs, al).collect()} == {1: "ask bob about it Robert", 2: "bobby", 3: "老王在吗 Wang"}
    recs = spark.createDataFrame([(str(i), i) for i in range(8)], "ref_id string, recorded_at int")
    links = spark.createDataFrame([("0", "a"), ("1", "a"), ("1", "b"), ("2", "b"), ("3", "c"), ("0", "h"), ("1", "h")], "ref_id string, entity_id string")
    hits = spark.createDataFrame([(1, "0")], "query_id long, ref_id string")
    assert [(r.ref_id, r.hop, r.shared) for r in rt.entity_expand(hits, recs, links).orderBy("position").collect()] == [("1", 1, 2), ("2", 2, 1)]


def test_session_views_and_rerank_fallback(spark):
    m = spark.createDataFrame([("s", 1, "a", "one"), ("s", 2, "b", "  "), ("s", 3, "c", "three")], "session string, position int, ref_id string, body string")
    assert [r.view for r in rt.session_views(m).orderBy("position").collect()] == ["one", "one\nthree", "three"]
    scored = spark.createDataFrame([(1, "event", "1", "t", 0.5, 1, ["x"])], "query_id long, record_type string, ref_id string, title string, score double, position int, reasons array<string>")
    assert rt.rerank(scored, None).first().reasons == ["x", "reranker-fallback"]


# -- passages


BODY = "Date: 2024\nuser: hi\nassistant: hello\n```\nuser: not a header\n```\ntail"


def test_text_units():
    assert [(BODY[u.start : u.end], u.speaker, u.date) for u in passages.units_of(BODY)] == [("Date: 2024\nuser: hi\n", "user", "2024"), (BODY[BODY.index("assistant") :], "assistant", "2024")]
    assert passages.units_of("") == [] and [u.speaker for u in passages.units_of("## user [2020]\nx")] == ["user"]


def test_conversation_units():
    body = 'Session date: 2023/05\n[{"role": "user", "content": "a"}, {"role": "Assistant", "content": "b"}]'
    got = passages.units_of(body)
    assert [(u.speaker, u.date) for u in got] == [("user", "2023/05"), ("assistant", "2023/05")] and got[0].start == 0 and got[-1].end == len(body) and got[0].end == got[1].start
    assert passages.conversation_units(body[:-1] + ",]") is None and passages.conversation_units("[]") is None


def test_windows_cover_everything():
    rng = random.Random(3)
    for _ in range(50):
        body = "".join(rng.choice(["word ", "x", "\n", "\r\n", "\n\n", "é", "user: "]) for _ in range(rng.randint(0, 900)))
        spans = passages.spans_of(body, 100, 20)
        seen = set()
        for s, e in spans:
            assert 0 <= s < e <= len(body) and e - s <= 100 and body[e - 1 : e + 1] != "\r\n"
            seen.update(range(s, e))
        assert seen == set(range(len(body)))


def test_passage_identity(spark):
    df = spark.createDataFrame([("p", "x" * 2000), ("q", None), ("r", "")], "parent_id string, body string")
    rows = passages.split(df).orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 900), (780, 1680), (1560, 2000)]
    digest = hashlib.sha256(b"x" * 2000).hexdigest()
    assert rows[0].passage_id == passages.identity("p", digest, 0, 900) and rows[0].body_sha256 == digest and rows[0].line_end == 1


def test_unique_place(spark):
    df = spark.createDataFrame([("abcabc x", "x"), ("abcabc", "abc"), ("abc", "z")], "a string, b string")
    assert [(r.start, r.end) for r in passages.unique_place(df, "a", "b").collect()] == [(7, 8), (None, None), (None, None)]


# -- packing and evaluation


@pytest.mark.parametrize("budget", [0, 13, 60, 200, 400, 1800])
def test_pack_stays_in_budget(spark, budget):
    rows = [(1, "what about the fox", "p", i, "event", str(i), "A title " * 4, f"Body {i}. " + "The fox must not be fed. Other words follow here. " * 12) for i in range(1, 6)]
    df = spark.createDataFrame([*rows, (1, "what about the fox", "p", 6, "event", "6", "copy", rows[0][7])], "query_id long, query string, project_id string, position int, record_type string, ref_id string, title string, body string")
    got = context.pack(df, budget).first()
    assert got.n_bytes <= budget and got.n_packed + got.n_omitted == 5
    if budget == 1800:
        assert got.n_packed == 5 and "must not" in got.context


def test_greedy_passes_over():
    assert context.greedy([5, 10, 3, 2], 10) == [True, False, True, True]


def test_excerpt_keeps_condition():
    text = "Plain one. You must never delete it. The zebra matches here. More words."
    got = context.excerpt(text, "zebra", 50)
    assert "never" in got and context.size(got) <= 50


def test_evidence(spark):
    rows = [(1, ["a", "b"], ["a", "b"], ["a"], ["z"], []), (2, [], ["q"], ["q"], [], ["q"]), (3, ["a"], [], [], [], []), (4, ["a"], ["a"], ["a"], ["a"], [])]
    s = "array<string>"
    got = {r.question: r for r in evaluation.score_evidence(spark.createDataFrame(rows, f"question int, gold {s}, retrieved {s}, retained {s}, forbidden {s}, foreign {s}")).collect()}
    assert got[1].failures == ["context_budget_drop", "incomplete_evidence"] and got[1].evidence_recall == 0.5
    assert got[2].failures == ["scope_error", "unanswerable_false_retrieval"] and got[2].evidence_recall is None
    assert got[3].failures == ["recall_miss"] and got[4].failures == ["forbidden_time_evidence"] and got[4].full_coverage


@pytest.mark.parametrize(
    ("text", "flags"),
    [
        ('{"answer":"x","abstained":false,"citations":["s"]}', []), ('{"answer":"x","abstained":false,"citations":["s","s"]}', ["duplicate_citation"]), ('{"answer":"","abstained":true,"citations":[]}', []), ('{"answer":"x","abstained":true,"citations":[]}', ["inconsistent_abstention"]),
        ('{"answer":"x","answer":"y","abstained":false,"citations":[]}', ["format_error"]), ('```json\n{"a":1}\n```', ["format_error", "markdown_wrapper"]), (None, ["format_error"]), ('{"answer":"x","abstained":false,"citations":["u"]}', ["unknown_citation"]), ('{"answer":"x","abstained":false,"citations":[]}', ["answer_without_citations"]),
    ],
)
def test_reader(text, flags):
    assert evaluation.read_output(text, ["s"])[3] == flags


def test_score_answers(spark):
    rows = [
        ("1", "b", '{"answer":"Ｆoo  Bar","abstained":false,"citations":["s"]}', ["s"], ["s"], ["foo bar"], False, "", "stop"), ("2", "b", '{"answer":"","abstained":true,"citations":[]}', [], [], ["none"], True, "", "stop"),
        ("3", "b", '{"answer":"","abstained":true,"citations":[]}', ["s"], ["s"], ["x"], False, "", "length"), ("4", "b", "nonsense", ["s"], ["s"], ["x"], False, "boom", None),
    ]
    s = "array<string>"
    scored = evaluation.score_answers(spark.createDataFrame(rows, f"question_id string, baseline string, text string, source_ids {s}, gold {s}, accepted {s}, unanswerable boolean, error_type string, finish_reason string"))
    got = {r.question_id: r for r in scored.collect()}
    assert got["1"].exact_match and got["2"].correct_abstention and got["3"].flags == ["answerable_question_refused", "output_truncated"] and got["4"].flags == ["format_error", "reader_error"]
    expected = spark.createDataFrame([("b", 5, 4, 1), ("none", 2, 1, 1)], "baseline string, expected long, expected_answerable long, expected_unanswerable long")
    total = {r.baseline: r for r in evaluation.summary(scored, expected, "baseline").collect()}
    b, none = total["b"], total["none"]
    assert (b.completed, b.pending, b.exact_match_rate, b.format_failure_rate, b.abstention_accuracy, b.refusal_rate) == (4, 1, 0.4, 0.2, 1.0, 0.25)
    assert (none.completed, none.exact_match_rate, none.abstention_accuracy) == (0, 0.0, 0.0)
    assert {(r.flag, r.n) for r in evaluation.flag_counts(scored, "baseline").collect()} == {("answerable_question_refused", 1), ("format_error", 1), ("output_truncated", 1), ("reader_error", 1)}


def test_overlap_and_percentile(spark):
    assert one(spark, reports.overlap(F.col("a"), F.col("b")), a=["x", "y"], b=["y"]) == 1.0
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,)], "v double")
    assert df.select(evaluation.percentile("v", 0.95).alias("p")).first() == (9.2,)


def test_exact_percentiles(spark):
    """Against numpy, with a sketch so coarse that brackets matter, ties, groups of one and nulls."""
    rng = random.Random(5)
    groups = {"a": [rng.gauss(0, 1) for _ in range(3000)], "b": [float(rng.randint(0, 3)) for _ in range(500)], "c": [7.0], "d": [1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None)], "g string, v double")
    points = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    for r in evaluation.exact_percentiles(df, ["g"], "v", points, accuracy=50).collect():
        assert [r[n] for n in points] == pytest.approx([np.quantile(groups[r.g], p) for p in points.values()], abs=1e-6)
    for r in evaluation.exact_percentiles(df, ["g"], "v", points, accuracy=50, between=False).collect():
        vs = sorted(groups[r.g])
        assert [r[n] for n in points] == [vs[min(len(vs) - 1, math.floor(len(vs) * p))] for p in points.values()]


# -- sources


EVENT = {f: "x" for f in ev.REQUIRED} | {"kind": "episode", "tags": ["b", "a"], "schema_version": 1}


def test_event_files(spark, tmp_path):
    text = lambda meta, body: "---\n" + "\n".join(f"{k}: {ev.canonical(v)}" for k, v in sorted(meta.items())) + f"\n---\n\n{body}\n"
    for name, content in {"a.md": text(EVENT, "Body\nline"), "b.md": text(EVENT | {"odd": 1}, "x"), "c.md": "plain", "d.md": text(EVENT, "x").replace("title", "kind", 1)}.items():
        (tmp_path / name).write_text(content)
    got = {r.file_path[-4:]: r for r in ev.read_events(spark, str(tmp_path)).collect()}
    assert got["a.md"].body == "Body\nline" and got["a.md"].error is None and got["a.md"].meta["tags"] == '["b","a"]'
    assert "odd" in got["b.md"].error and got["c.md"].error == "no front matter" and "repeated" in got["d.md"].error
    back = ev.read_events(spark, str(tmp_path)).where("error IS NULL").select(ev.serialize(F.col("meta"), F.col("body")).alias("t"), ev.field("kind").alias("k")).first()
    assert back.t == text(EVENT, "Body\nline") and back.k == "episode"


def test_notes(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\ntitle: T\ntime: 2024-01-01 00:00:00 +0000\nproject_root: /r\ntags: a,b\n---\nBody\n")
    (tmp_path / "bad.md").write_text("---\ntitle: T\n---\nBody\n")
    got = ev.read_notes(spark, str(tmp_path)).collect()
    assert [(r.title, r.project_root, r.body) for r in got] == [("T", "/r", "Body")]


def test_haystack(spark):
    turn = [("user", "hi")]
    rows = [("q1", "why", "a", "kind", [turn, turn, turn], ["s1", "s2", "s1"], ["d1", "d2", "d3"], ["s1"]), ("q2_abs", "x", "b", "kind", [turn], ["s9"], ["d"], ["s9"])]
    df = spark.createDataFrame(rows, "question_id string, question string, answer string, question_type string, haystack_sessions array<array<struct<role:string,content:string>>>, haystack_session_ids array<string>, haystack_dates array<string>, answer_session_ids array<string>")
    sources, questions = ev.haystack(df)
    got = {r.question_id: r for r in questions.collect()}
    assert sources.count() == 4 and len(got["q1"].required_source_ids) == 2 and got["q2_abs"].unanswerable and got["q2_abs"].required_source_ids == []
    assert sources.select("source_id").distinct().count() == 4


def test_stream(spark, tmp_path):
    from cairnlake.streaming import ingest

    df = spark.createDataFrame([("p", "k", DAY(1)), ("p", "k", DAY(1)), ("p", "l", DAY(1))], "project_id string, idempotency_key string, recorded_at timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = ingest.first_writes(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    ingest.to_log(stream, f"{tmp_path}/out", f"{tmp_path}/cp").start().awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


# -- the write side


def test_append_events(spark):
    from cairnlake.operators import writes

    kinds = "event_id string, project_id string, scope string, scope_id string, kind string, title string, tags array<string>, body string, recorded_at string, idempotency_key string"
    row = lambda e, k="episode", title="t", body="b", key="", tags=("A", "a"), scope="project": (e, "p", scope, "", k, title, list(tags), body, e, key)
    log = spark.createDataFrame([row("1", key="x"), row("2", body="old")], kinds)
    new = spark.createDataFrame([row("3", key="x"), row("4", key="y"), row("5", key="y"), row("6", k="memo"), row("7", title=" "), row("8", body="password: hunter22"), row("2", body=" old "), row("1", body="other"), row("9", scope="session")], kinds)
    added, refused = writes.append_events(log, new)
    got = {r.event_id: r for r in added.collect()}
    assert set(got) == {"4", "9"} and got["4"].tags == ["A"] and got["4"].scope_id == "p" and got["9"].scope_id == "session"
    assert {(r.event_id, *r.refused) for r in refused.collect()} == {("6", "invalid kind"), ("7", "title and content are required"), ("8", "secret"), ("1", "event id exists with other content")}


def test_candidates(spark):
    from cairnlake.operators import writes

    decided = spark.createDataFrame([("a", "validated", ""), ("b", "validated", ""), ("c", "rejected", "bad"), ("d", "validated", "")], "candidate_id string, state string, reason string")
    facts = spark.createDataFrame([("a", 0, "k", ""), ("a", 1, "m", ""), ("b", 0, "k", ""), ("c", 0, "k", ""), ("d", 0, "k", "f0")], "candidate_id string, position long, fact_key string, supersedes string")
    near = spark.createDataFrame([("a", 1, "m", "f1", "m", 0.9), ("b", 0, "k", "f2", "other", 0.95), ("c", 0, "k", "f3", "k", 0.9), ("d", 0, "k", "f4", "k", 0.9)], "candidate_id string, position long, candidate_fact_key string, fact_id string, fact_key string, similarity double")
    want = {
        "review": ({"a": "needs_confirmation", "b": "needs_confirmation", "c": "rejected", "d": "active"}, {("d", 0, "f0")}),
        "skip": ({"a": "active", "b": "active", "c": "rejected", "d": "active"}, {("a", 0, ""), ("d", 0, "f0")}),
        "supersede": ({"a": "active", "b": "needs_confirmation", "c": "rejected", "d": "active"}, {("a", 0, ""), ("a", 1, "f1"), ("d", 0, "f0")}),
    }
    for action, (states, written) in want.items():
        results, rows = writes.consolidate(decided, facts, near, action)
        assert {r.candidate_id: r.state for r in results.collect()} == states
        assert {(r.candidate_id, r.position, r.supersedes) for r in rows.collect()} == written
    with pytest.raises(ValueError, match="unknown action"):
        writes.override(decided, near, "drop")


def test_record_deletion(spark):
    from cairnlake.operators import writes

    e = spark.createDataFrame([("e1", "p", "", "candidate-summary:c1", None), ("e2", "p", "e1", "", None), ("e3", "p", "", "", "c1"), ("e4", "p", "", "", None), ("e5", "q", "e1", "", None)], "event_id string, project_id string, source_event_id string, idempotency_key string, batch_id string")
    f = spark.createDataFrame([("f2", "p", "e2", ""), ("f4", "p", "e4", "")], "fact_id string, project_id string, assertion_event_id string, source_event_id string")
    c = spark.createDataFrame([("c1", "p"), ("c2", "p")], "candidate_id string, project_id string")
    got = {(r.deleted_id, r.what) for r in writes.record_deletion(e, f, c, "p", "e1").collect()}
    assert got == {("e1", "event"), ("e2", "event"), ("e3", "event"), ("f2", "fact"), ("c1", "candidate")}


def test_uuid5(spark):
    import uuid

    for name in ("", "eval:a", "eval:é😀"):
        assert one(spark, evaluation.uuid5(F.col("n")), n=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_rubric_points(spark):
    answers = spark.createDataFrame([("1", "b", "The Blue  whale"), ("2", "b", "red"), ("3", "b", None)], "question_id string, baseline string, answer string")
    point = lambda i, *w: (i, list(w))
    rubrics = spark.createDataFrame(
        [("1", [point("p", "bluewhale", "orca"), point("q", "the")], [point("f", "^red")]), ("2", [point("p", "red")], [point("f", "R.D")]), ("3", [point("p", "x")], [])],
        "question_id string, required array<struct<id: string, any_of: array<string>>>, forbidden array<struct<id: string, patterns: array<string>>>",
    )
    got = {r.question_id: (r.hit, r.points, r.forbidden, r.passed) for r in evaluation.rubric_points(answers, rubrics).collect()}
    assert got == {"1": (2, 2, [], True), "2": (1, 1, ["f"], False), "3": (0, 1, [], False)}


def test_reader_cases(spark):
    body = "One two three four. Five six seven eight must not be lost. " * 20
    hits = spark.createDataFrame([("q", "b", "seven?", 1, "s1", "t", "short"), ("q", "b", "seven?", 2, "s2", "t", body), ("q", "b", "seven?", 3, "s3", "t", "last")], "question_id string, baseline string, question string, position long, source_id string, title string, body string")
    full = evaluation.reader_cases(hits, 600).first()
    part = evaluation.reader_cases(hits, 900, "excerpt").first()
    assert full.source_ids == full.complete_source_ids == ["s1", "s3"] and full.n_bytes == len(full.payload.encode()) <= 600
    assert part.source_ids == ["s1", "s2", "s3"] and part.complete_source_ids == ["s1", "s3"] and part.n_bytes <= 900
    same = evaluation.rebuilt(spark.createDataFrame([("q", "b", full.payload), ("r", "b", "{}")], "question_id string, baseline string, payload string"), hits, 600)
    assert {r.question_id: r.same for r in same.collect()} == {"q": True, "r": False}


def test_pack_rules():
    rules = [("A.md", "short"), ("B.md", "x" * 500), ("C.md", "y" * 5000)]
    whole = context.pack_rules(rules, 1000)
    assert "short" in whole and "x" * 500 in whole and "C.md [not fully loaded" in whole and len(whole.encode()) <= 1000
    assert context.pack_rules(rules, 39) == context.pack_rules([], 500) == ""
    assert context.pack_rules(rules, 80).endswith("not loaded: 2.\n") or len(context.pack_rules(rules, 80).encode()) <= 80


def test_pack_spans():
    span = lambda i, n=20: {"head": f"h{i}", "wide": f"w{i}" * n, "text": f"t{i}"}
    hits = [{"metadata": "m0\n", "marked": "x0\n", "extra": True, "spans": [span(0)]}, {"metadata": "m1\n", "marked": "x1\n", "extra": False, "spans": [span(1), span(2)]}, {"metadata": "m2\n", "marked": "x2\n", "extra": False, "spans": [span(3)]}]
    text, packed, omitted = context.pack_spans("base\n", hits, "q", 2000)
    assert (packed, omitted) == (4, 0) and [text.index(x) for x in ("w1", "w3", "w2", "w0")] == sorted(text.index(x) for x in ("w1", "w3", "w2", "w0"))
    for budget in range(0, 400, 7):
        for fallback in (False, True):
            text, packed, omitted = context.pack_spans("base\n", hits, "q", budget, fallback)
            assert len(text.encode()) <= budget and packed + omitted == 4


def test_expansions_and_facts(spark):
    text = one(spark, tx.valid_expansions(F.col("q"), F.col("o")), q="Who is it", o=["  who   is IT", "a\nb", "A b", "", "x" * 301, "c", "d", "e"])
    assert text == ["a b", "c", "d"]
    assert one(spark, tx.valid_hyde(F.col("q"), F.col("o"), F.col("h")), q="Who", o=["He"], h=" he ") == "" and one(spark, tx.valid_hyde(F.col("q"), F.col("o"), F.col("h")), q="Who", o=["He"], h="She " * 1000) == ("She " * 300)
    rows = spark.createDataFrame([([("k", "v", 2.0), ("K", "V", 0.1), ("", "x", 0.1), ("n", "y" * 700, None)],)], "o array<struct<key: string, value: string, confidence: double>>")
    assert [tuple(f) for f in rows.select(tx.valid_facts(F.col("o")).alias("f")).first().f] == [("k", "v", 1.0), ("n", "y" * 600, 0.5)]


def test_checked_spans(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    q = spark.createDataFrame([("1", False, ["s"], "p", "x", ""), ("2", True, [], "p", "x", ""), ("3", False, ["s"], "other", "x", ""), ("4", False, ["s", "t"], "p", "x", "")], "question_id string, unanswerable boolean, required_source_ids array<string>, project string, scope string, scope_id string")
    s = spark.createDataFrame([("s", "hello world", "p", "x", ""), ("t", "bye", "p", "x", "")], "source_id string, body string, project string, scope string, scope_id string")
    spans = spark.createDataFrame([("1", "a", "s", 0, 5, sha("hello")), ("2", "b", "s", 0, 5, sha("hello")), ("3", "c", "s", 0, 5, sha("hello")), ("4", "d", "s", 0, 5, sha("hello")), ("4", "d", "s", 6, 99, sha("x")), ("9", "e", "s", 0, 1, sha("h"))], "question_id string, evidence_id string, source_id string, start int, end int, quote_sha256 string")
    got = {(r.question_id, r.fault) for r in evaluation.span_faults(spans, q, s).collect()}
    assert got == {("2", "spans of an unanswerable question"), ("3", "source out of scope"), ("4", "evidence id"), ("4", "range"), ("4", "other sources than required"), ("9", "unknown question")}


def test_dataset_round_trip(spark, tmp_path):
    schemas = {"sources": "source_id string, body string", "questions": "question_id string, split string, answer string"}
    sources = spark.createDataFrame([("s1", "é\n"), ("s2", None), ("s2", None)], schemas["sources"])
    questions = spark.createDataFrame([("1", "dev", "a"), ("2", "test", None)], schemas["questions"])
    ev.write_dataset(f"{tmp_path}/d", sources, questions)
    got = ev.read_dataset(spark, f"{tmp_path}/d", schemas)
    assert set(got) == {"sources", "questions.dev", "questions.test"} and got["sources"].count() == 3 and got["questions.test"].first().question_id == "2"
    with pytest.raises(Exception, match="(?i)exists"):
        ev.write_dataset(f"{tmp_path}/d", sources, questions)
    sources.limit(2).write.mode("overwrite").json(f"{tmp_path}/d/sources")
    with pytest.raises(ValueError, match="sources differs"):
        ev.read_dataset(spark, f"{tmp_path}/d", schemas)


def test_shadow_rows(spark, tmp_path):
    rows = spark.createDataFrame([("q", ["a", "b"], ["b", "c", "d"])], "query string, legacy_refs array<string>, refs array<string>")
    ev.append_shadow(rows, f"{tmp_path}/s")
    ev.append_shadow(rows, f"{tmp_path}/s")
    got = spark.read.parquet(f"{tmp_path}/s").collect()
    assert len(got) == 2 and got[0].overlap == 0.5 and got[0].query_sha256 == hashlib.sha256(b"q").hexdigest() and "query" not in got[0]


def test_neighbours_within(spark):
    parts = spark.createDataFrame([("p", f"g{i}", i * 10, i * 10 + (50 if i == 1 else 10)) for i in range(6)], "parent_id string, passage_id string, start long, end long")
    target = spark.createDataFrame([("p", "g2")], "parent_id string, passage_id string")
    ids = lambda radius, most: [r.passage_id for r in passages.neighbors_within(parts, target, radius, most).orderBy("start").collect()]
    assert ids(0, 10) == ["g2"] and ids(2, 40) == ["g0", "g2", "g3", "g4"] and ids(1, 70) == ["g1", "g2", "g3"] and ids(5, 30) == ["g0", "g2", "g3"]
