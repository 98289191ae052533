"""The bitemporal memory as views over an append-only log: facts, eligibility, source chains, lineage, lifecycle.

Event rows: event_id, project_id, scope, scope_id, kind, title, tags, body, observed_at, recorded_at, source_event_id,
idempotency_key, operation, target_id. Assertion rows add fact_id, fact_key, value_json, status, valid_from, valid_to,
expires_at, supersedes, confidence. Times are timestamps; absent is null. Nothing is updated in place: a state is a
transformation of the log.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, release

#: Up to so many edges, counted first, a closure is walked in one task; beyond that in rounds of joins.
WALK_EDGES = 500_000


def first_write(events: DataFrame, keys: list[str] = ["project_id", "idempotency_key"]) -> DataFrame:
    """Idempotency: of the rows with one non-empty key the first recorded stays."""
    order = Window.partitionBy(*keys).orderBy("recorded_at", "event_id")
    keyed = events.where(F.col(keys[-1]) != "").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return keyed.unionByName(events.where(F.coalesce(F.col(keys[-1]), F.lit("")) == ""))


def committed(events: DataFrame, markers: DataFrame) -> DataFrame:
    """Events of a batch show once the batch's marker (batch_id, event_ids) lists them."""
    listed = markers.select(F.col("batch_id").alias("_b"), F.explode("event_ids").alias("_e"))
    single = events.where(F.col("batch_id").isNull())
    return single.unionByName(events.join(listed, (F.col("batch_id") == F.col("_b")) & (F.col("event_id") == F.col("_e")), "left_semi"))


def derive_facts(assertions: DataFrame) -> DataFrame:
    """Fact versions: a version that another one supersedes is closed where its successor begins."""
    then = assertions.where(F.col("supersedes").isNotNull()).groupBy("project_id", F.col("supersedes").alias("fact_id")).agg(F.max_by("valid_from", F.struct("recorded_at", "event_id")).alias("_next"))
    closed = assertions.join(then, ["project_id", "fact_id"], "left")
    superseded = F.col("_next").isNotNull()
    return closed.withColumn("valid_to", F.when(superseded, F.col("_next")).otherwise(F.col("valid_to"))).withColumn("status", F.when(superseded, F.lit("superseded")).otherwise(F.col("status"))).drop("_next")


def versions(facts: DataFrame) -> DataFrame:
    """History of each key: version number, and the interval closed by the next version."""
    w = Window.partitionBy("project_id", "fact_key").orderBy("recorded_at", "fact_id")
    return facts.withColumn("version", F.row_number().over(w)).withColumn("next_from", F.lead("valid_from").over(w))


def valid_at(point: Column, soft: bool = False) -> Column:
    open_end = F.col("valid_to").isNull() | (F.col("valid_to") > point)
    return (F.col("valid_from") <= point) & (open_end | (F.lit(soft) & (F.col("status") == "superseded")))


def eligible_events(events: DataFrame, scope: str, scope_id: str, at: Column | None = None, known: Column | None = None) -> DataFrame:
    out = events.where((F.col("scope") == scope) & (F.col("scope_id") == scope_id) & (F.col("status") == "active") & (F.coalesce("operation", F.lit("")) == ""))
    out = out.where(F.col("observed_at") <= at) if at is not None else out
    return out.where(F.col("recorded_at") <= known) if known is not None else out


def eligible(
    events: DataFrame, facts: DataFrame, project: str, scope: str, scope_id: str, now: Column, view: str = "current", at: Column | None = None, known: Column | None = None, soft: bool = False, chains: bool = True
) -> DataFrame:
    """The records that retrieval may see: (record_type, ref_id, event_id, title, tags, body, status, recorded_at, valid_from, valid_to, kind).

    A view of ``current`` takes now as the instant unless one is given; any other view has no instant of its own.
    Expiry is held against now in the current view only.
    """
    point = at if at is not None else now if view == "current" else None
    seen = eligible_events(events.where(F.col("project_id") == project), scope, scope_id, at, known)
    plain = seen.where(F.col("kind") != "fact").select(
        F.lit("event").alias("record_type"), F.col("event_id").alias("ref_id"), "event_id", "title", "tags", "body", "status", "recorded_at", F.col("observed_at").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), "kind"
    )
    kept = facts.where((F.col("project_id") == project) & F.col("status").isin("active", "superseded"))
    kept = kept.where(valid_at(point, soft)) if point is not None else kept
    kept = kept.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)) if view == "current" else kept
    e = seen.select("event_id", "title", "tags", "body", "recorded_at", "kind")
    stated = kept.drop("title", "tags", "body", "recorded_at", "kind", "event_id").withColumn("event_id", F.col("assertion_event_id")).join(e, "event_id")
    stated = stated.select(F.lit("fact").alias("record_type"), F.col("fact_id").alias("ref_id"), "event_id", "title", "tags", "body", "status", "recorded_at", "valid_from", "valid_to", "kind")
    records = plain.unionByName(stated)
    if not chains:
        return records
    good = sound_sources(provenance(events, facts, project, scope, scope_id), now, point, soft)
    return records.join(good, records.event_id == good.sound_id, "left_semi")


def provenance(events: DataFrame, facts: DataFrame, project: str, scope: str, scope_id: str) -> DataFrame:
    """Nodes of the source graph: an event, its fact if it asserts one, and its parent."""
    f = facts.where(F.col("project_id") == project).select(
        F.col("assertion_event_id").alias("event_id"), "fact_id", F.col("status").alias("fact_status"), F.col("source_event_id").alias("fact_source"), "valid_from", "valid_to", "expires_at"
    )
    e = events.where((F.col("project_id") == project) & (F.col("scope") == scope) & (F.col("scope_id") == scope_id)).select("event_id", F.col("status").alias("event_status"), F.col("source_event_id").alias("event_source"))
    return e.join(f, "event_id", "left")


def sound_sources(nodes: DataFrame, now: Column, point: Column | None = None, soft: bool = False) -> DataFrame:
    """(sound_id) of nodes whose whole chain of sources stands: each exists, is live and in its window, up to a root.

    Soundness spreads from the roots down the edges, a join a round, so cycles and missing parents are never reached.
    """
    live = (F.col("event_status") == "active") & (F.coalesce("fact_status", F.lit("")) != "retracted")
    if point is not None:
        ended = F.col("valid_to").isNotNull() & (F.col("valid_to") <= point) & ~(F.lit(soft) & (F.col("fact_status") == "superseded"))
        fits = F.col("fact_status").isin("active", "superseded") & (F.col("valid_from") <= point) & ~ended & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
        live = live & (F.col("fact_id").isNull() | fits)
    parent = F.coalesce(F.nullif(F.col("event_source"), F.lit("")), F.nullif(F.col("fact_source"), F.lit("")))
    own_root = F.col("fact_id").isNotNull() & (parent == F.col("event_id")) & (F.coalesce("event_source", F.lit("")) == "")
    steps = nodes.where(live).select("event_id", F.when(~F.coalesce(own_root, F.lit(False)), parent).alias("parent"))
    sound = steps.where("parent IS NULL").select(F.col("event_id").alias("sound_id")).distinct()
    pending = steps.where("parent IS NOT NULL")
    return closure(sound, pending.select(F.col("parent").alias("src"), F.col("event_id").alias("dst")), "sound_id")


def walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Ids reached from the rows without src along the others."""
    after = defaultdict(list)
    for src, dst in pdf.loc[pdf["src"].notna(), ["src", "dst"]].itertuples(index=False):
        after[src].append(dst)
    todo = pdf.loc[pdf["src"].isna(), "dst"].drop_duplicates().tolist()
    seen = set(todo)
    while todo:
        for dst in after.get(todo.pop(), ()):
            if dst not in seen:
                seen.add(dst)
                todo.append(dst)
    return pd.DataFrame({"id": list(seen)}, dtype=object)


def closure(start: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """All ids that edges (src, dst) reach from start (one column), each once, whatever cycles and diamonds there are.

    A graph of at most ``WALK_EDGES`` edges is walked in one task, however deep it is. In a larger one each round joins
    the ids found last with the edges, keeps those not seen before and writes them; it ends when there are none.
    """
    start = start.toDF("id").where("id IS NOT NULL").distinct()
    edges = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    if edges.limit(WALK_EDGES + 1).count() <= WALK_EDGES:
        hit = start.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi")  # bounded by the edges
        rows = edges.union(hit.select(F.lit(None).cast("string"), "id")).withColumn("one", F.lit(1))
        return start.union(rows.groupBy("one").applyInPandas(walk, "id string")).distinct().toDF(name)
    edges = cut(edges.distinct(), "edges")
    seen = last = cut(start, "reached")
    while True:
        step = edges.join(last, edges.src == last.id).select(F.col("dst").alias("id")).distinct()
        last = cut(step.join(seen, "id", "left_anti"), "reached")
        if last.isEmpty():
            break
        seen = seen.union(last)
    release(edges)
    return seen.toDF(name)


def lineage_edges(events: DataFrame, facts: DataFrame) -> DataFrame:
    """(project_id, src, dst) where dst falls with src: derived events, derived facts' assertions, siblings of one candidate."""
    derived = events.where(F.coalesce("source_event_id", F.lit("")) != "").select("project_id", F.col("source_event_id").alias("src"), F.col("event_id").alias("dst"))
    asserted = facts.where(F.coalesce("source_event_id", F.lit("")) != "").select("project_id", F.col("source_event_id").alias("src"), F.col("assertion_event_id").alias("dst"))
    parts = F.split("idempotency_key", ":")
    unit = events.where(F.col("idempotency_key").rlike("^candidate-(summary|fact):")).select("project_id", F.concat(F.lit("candidate:"), F.get(parts, 1)).alias("unit"), "event_id")
    return reduce(DataFrame.union, [derived, asserted, unit.select("project_id", "unit", "event_id"), unit.select("project_id", "event_id", "unit")]).distinct()


def in_project(project: Column | str, key: Column | str) -> Column:
    """An id together with its project, so that nothing is reached in another one."""
    return F.concat_ws("\x1f", project, key)


def lineage(events: DataFrame, facts: DataFrame, project: str, target_id: str) -> DataFrame:
    """(event_id) of the target (an event or a fact) and all that was derived from it, never of another project."""
    named = facts.where((F.col("project_id") == project) & (F.col("fact_id") == target_id)).select("assertion_event_id")
    start = named.union(events.where((F.col("project_id") == project) & (F.col("event_id") == target_id)).select("event_id")).distinct()
    edges = lineage_edges(events.where(F.col("project_id") == project), facts.where(F.col("project_id") == project))
    found = closure(start, edges.select("src", "dst"), "event_id")
    return found.where(~F.col("event_id").startswith("candidate:"))


def retract(events: DataFrame, facts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and facts with the status that a set of retracted events (event_id) gives them."""
    g = gone.select(F.col("event_id").alias("_gone")).distinct()
    mark = lambda df, key: df.join(g, df[key] == F.col("_gone"), "left").withColumn("status", F.when(F.col("_gone").isNotNull(), F.lit("retracted")).otherwise(F.col("status"))).drop("_gone")
    return mark(events, "event_id"), mark(facts, "assertion_event_id")


def superseded_derivations(events: DataFrame, facts: DataFrame, project: str, fact_id: str) -> DataFrame:
    """What falls when a fact is superseded: its derivations, not itself."""
    own = facts.where(F.col("fact_id") == fact_id).select(F.col("assertion_event_id").alias("event_id"))
    return lineage(events, facts, project, fact_id).join(own, "event_id", "left_anti")


def purge(table: DataFrame, key: str, ledger: DataFrame) -> DataFrame:
    """Rows that no deletion (deleted_id) names."""
    return table.join(ledger.select(F.col("deleted_id").alias(key)).distinct(), key, "left_anti")


def merge_ledgers(*ledgers: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, ledgers).dropDuplicates()


def resolve_entities(mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, aliases, links) from (project_id, event_id, name, type, aliases, relation, recorded_at).

    An entity is (project, type, name); of entities that claim one alias the last one recorded has it.
    """
    m = mentions.withColumn("name", F.btrim("name")).where("name <> ''").withColumn("type", F.coalesce(F.nullif(F.btrim("type"), F.lit("")), F.lit("concept")))
    m = m.withColumn("entity_id", F.sha2(F.concat_ws("\x1f", "project_id", "type", "name"), 256))
    ents = m.select("entity_id", "project_id", "type", "name").dropDuplicates(["entity_id"])
    spelled = m.select("project_id", "entity_id", "recorded_at", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    spelled = spelled.withColumn("alias", F.lower(F.btrim("alias"))).where("alias <> ''")
    aliases = spelled.groupBy("project_id", "alias").agg(F.max_by("entity_id", F.struct("recorded_at", "entity_id")).alias("entity_id"))
    links = m.groupBy("event_id", "entity_id").agg(F.min("relation").alias("relation"))
    return ents, aliases, links


def prune_orphans(ents: DataFrame, links: DataFrame) -> DataFrame:
    return ents.join(links.select("entity_id").distinct(), "entity_id", "left_anti")


def violations(facts: DataFrame) -> DataFrame:
    """Integrity: (rule, id) of each breach."""
    dup = facts.where("status = 'active'").groupBy("project_id", "fact_key", "scope", "scope_id").agg(F.count("*").alias("n"), F.min("fact_id").alias("id")).where("n > 1").select(F.lit("one active fact per key and scope").alias("rule"), "id")
    order = facts.where("valid_to <= valid_from").select(F.lit("valid_to after valid_from").alias("rule"), F.col("fact_id").alias("id"))
    old = facts.select(F.col("fact_id").alias("old_id"), F.col("fact_key").alias("old_key"), F.col("valid_from").alias("old_from"))
    chain = facts.join(old, facts.supersedes == old.old_id).where((F.col("fact_key") != F.col("old_key")) | (F.col("valid_from") < F.col("old_from"))).select(F.lit("successor of the same key, not earlier").alias("rule"), F.col("fact_id").alias("id"))
    return dup.union(order).union(chain)


def decide(candidates: DataFrame) -> DataFrame:
    """Candidate policy over (summary, kind, facts array<struct<fact_key, value, title, bound>>, evidence_valid): adds state, reason."""
    from ..functions.text import high_risk

    risky = F.exists("facts", lambda f: high_risk(F.concat_ws(" ", f["fact_key"], f["value"], f["title"])) & ~F.coalesce(f["bound"], F.lit(False)))
    nameless = F.exists("facts", lambda f: F.coalesce(f["fact_key"], F.lit("")) == "")
    empty = (F.coalesce("summary", F.lit("")) == "") & (F.size("facts") == 0)
    steps = [
        (nameless, "rejected", "invalid fact list"),
        (risky, "needs_confirmation", "high-risk fact without evidence bound to its claim"),
        (empty, "rejected", "neither summary nor facts"),
        (F.col("kind").isin("procedure", "artifact_ref") & ~F.col("evidence_valid"), "needs_confirmation", "needs evidence that can be verified"),
    ]
    state, reason = F.lit("validated"), F.lit("policy passed")
    for test, s, r in reversed(steps):
        state, reason = F.when(test, s).otherwise(state), F.when(test, r).otherwise(reason)
    return candidates.withColumn("state", state).withColumn("reason", reason)


def near_duplicates(probes: DataFrame, facts: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Best other active fact of the same project and scope for each probe: both have (id, block, vector); ties by id."""
    from .retrieval import best_dots

    rows = facts.select(F.lit("fact").alias("record_type"), F.col("id").cast("string").alias("ref_id"), "block", "vector")
    found = best_dots(rows, probes.select(F.col("id").alias("query_id"), "block", "vector"), threshold, 2)  # the probe itself may be one
    scored = found.select(F.col("query_id").alias("probe_id"), F.col("ref_id").cast("long").alias("fact_id"), F.round("score", 6).alias("similarity"))
    best = Window.partitionBy("probe_id").orderBy(F.desc("similarity"), "fact_id")
    return scored.where((F.col("similarity") >= threshold) & (F.col("probe_id") != F.col("fact_id"))).withColumn("_n", F.row_number().over(best)).where("_n = 1").select("probe_id", "fact_id", "similarity")


def rebuild(log: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The whole state from the log: committed first writes, assertions before operations, closing, retraction."""
    events = first_write(log).withColumn("status", F.lit("active"))
    facts = derive_facts(events.where("kind = 'fact' AND fact_id IS NOT NULL").drop("status").withColumnRenamed("asserted_status", "status").withColumn("assertion_event_id", F.col("event_id")).withColumn("source_event_id", F.coalesce("source_event_id", "event_id")))
    targets = events.where("operation = 'retract'").select("project_id", "target_id")
    named = facts.select("project_id", F.col("fact_id").alias("target_id"), F.col("assertion_event_id").alias("id"))
    known = named.union(events.select("project_id", F.col("event_id").alias("target_id"), F.col("event_id").alias("id")))
    start = targets.join(known, ["project_id", "target_id"]).select(in_project("project_id", "id"))
    began = facts.where((F.col("status") == "superseded") & (F.col("valid_to") <= now)).select(in_project("project_id", "assertion_event_id").alias("_began"))
    edges = lineage_edges(events, facts).select(in_project("project_id", "src").alias("src"), in_project("project_id", "dst").alias("dst"))
    below = edges.join(began, edges.src == began["_began"], "left_semi").where("src <> dst").select("dst")
    gone = closure(start, edges, "id").union(closure(below, edges, "id"))
    return retract(events, facts, gone.select(F.substring_index("id", "\x1f", -1).alias("event_id")))


def as_of(facts: DataFrame, point: Column) -> DataFrame:
    """The version of each key that holds at an instant."""
    w = Window.partitionBy("project_id", "fact_key").orderBy(F.desc("valid_from"), F.desc("fact_id"))
    return facts.where(valid_at(point)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
