"""The write side as transformations: what is appended, what is refused and for which reasons, which state follows.

Nothing is updated in place. A function takes the tables as they are and the new rows, and returns the rows to append
(or the next version of a table) and, where rows can be refused, those with their reasons. Appending is one write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinct_tags, has_secret, high_risk
from ..sources.events import KINDS, SCOPES, STATUSES
from .memory import closure, lineage_edges

# Fixed values.
ACTIONS = ["review", "skip", "supersede"]
FACT_CONFIDENCE = 0.8
MOVED = "candidate materialized as immutable events"
APPROVED, REJECTED = "approved for deterministic consolidation", "explicitly rejected"


def reasons(*tests: tuple[Column, str]) -> Column:
    """The texts of the tests that hold; a test that is null doesn't."""
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), text) for test, text in tests]), lambda x: x.isNotNull())


def blank(c: str) -> Column:
    return F.coalesce(F.btrim(c), F.lit("")) == ""


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


# -- events and facts


def checked_events(new: DataFrame) -> DataFrame:
    """New event rows as they would be stored (trimmed, scope of its own, body's digest), with what speaks against them."""
    rows = new.withColumns({c: F.btrim(F.coalesce(c, F.lit(""))) for c in ("title", "body")}).withColumn("tags", distinct_tags(F.coalesce("tags", F.array().cast("array<string>"))))
    own = F.when(F.col("scope") == "project", F.col("project_id")).otherwise(F.col("scope"))
    said = F.concat_ws("\n", "title", "body", F.array_join("tags", " "))
    refused = reasons(
        (~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)), "invalid kind"),
        (~F.coalesce(F.col("scope").isin(SCOPES), F.lit(False)), "invalid scope"),
        (blank("title") | blank("body"), "title and content are required"),
        (has_secret(said), "secret"),
    )
    return rows.withColumn("scope_id", F.when(blank("scope_id"), own).otherwise(F.col("scope_id"))).withColumn("source_hash", F.sha2("body", 256)).withColumn("refused", refused)


def append_events(log: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(appended, refused). Of new rows with one idempotency key the first recorded counts, and none if the log has the key.

    A row whose event_id is in the log is no new row if it has the same content, and refused if it has another.
    """
    checked = checked_events(new)
    sound = checked.where(F.size("refused") == 0)
    keyed = first_by(sound.where(~blank("idempotency_key")), ["project_id", "idempotency_key"], "recorded_at", "event_id")
    keyed = keyed.join(log.select("project_id", "idempotency_key").distinct(), ["project_id", "idempotency_key"], "left_anti")
    every = first_by(keyed.unionByName(sound.where(blank("idempotency_key"))), ["event_id"], "recorded_at", "source_hash")
    stored = log.select("event_id", F.sha2(F.btrim(F.coalesce("body", F.lit(""))), 256).alias("_hash")).distinct()
    placed = every.join(stored, "event_id", "left")
    clash = placed.where(F.col("_hash") != F.col("source_hash")).withColumn("refused", F.array(F.lit("event id exists with other content")))
    return placed.where("_hash IS NULL").drop("_hash", "refused"), checked.where(F.size("refused") > 0).unionByName(clash.drop("_hash"))


def fact_events(new: DataFrame) -> DataFrame:
    """Event rows of new assertions, with what speaks against them.

    new: fact_key, value_json, title, conditions_json, status, valid_from, valid_to, confidence, bound (whether its evidence
    is bound to the claim) and an event's columns.
    """
    text = F.when(F.col("value_json").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), "value_json", F.lit("}")), "v string")["v"]).otherwise(F.col("value_json"))
    body = F.concat(text, F.when(F.col("conditions_json").isNotNull(), F.concat(F.lit("\nConditions: "), "conditions_json")).otherwise(F.lit("")))
    refused = reasons(
        (blank("fact_key"), "fact_key is required"),
        (~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), "invalid fact status"),
        (F.col("valid_to") <= F.col("valid_from"), "valid_to must be after valid_from"),
        (high_risk(F.concat_ws(" ", "fact_key", "title", text)) & ~F.coalesce("bound", F.lit(False)), "high-risk fact requires claim-bound evidence"),
    )
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(FACT_CONFIDENCE))))
    return new.withColumns({"refused": refused, "confidence": sure, "body": body, "title": F.coalesce(F.nullif("title", F.lit("")), "fact_key"), "fact_key": F.btrim("fact_key"), "kind": F.lit("fact")})


def checked_facts(new: DataFrame, events: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """Assertions with what the stored events and facts say against them (``refused``).

    A source must be an active event of the project and the same scope whose own fact, if it asserts one, holds now. A
    successor names an active fact of its key and scope and doesn't begin before it; without one, no active fact may have
    the key and scope.
    """
    key = ["project_id", "fact_key", "scope", "scope_id"]
    src = events.select("project_id", F.col("event_id").alias("source_event_id"), F.col("scope").alias("_s"), F.col("scope_id").alias("_sid"), F.col("status").alias("_status"))
    of = facts.select(F.col("assertion_event_id").alias("source_event_id"), F.col("status").alias("_fs"), F.col("valid_from").alias("_ff"), F.col("valid_to").alias("_ft"))
    at = events.select(F.col("event_id").alias("assertion_event_id"), "scope", "scope_id")
    placed = facts.drop("scope", "scope_id").join(at, "assertion_event_id")
    old = placed.select("project_id", F.col("fact_id").alias("supersedes"), F.col("fact_key").alias("_k"), F.col("status").alias("_os"), F.col("valid_from").alias("_of"), F.col("scope").alias("_oscope"), F.col("scope_id").alias("_osid"))
    held = placed.where("status = 'active'").select(*key).distinct().withColumn("_held", F.lit(True))
    rows = new.withColumns({c: F.nullif(c, F.lit("")) for c in ("source_event_id", "supersedes")}).join(src, ["project_id", "source_event_id"], "left").join(of, "source_event_id", "left").join(old, ["project_id", "supersedes"], "left").join(held, key, "left")
    derived, follows, active = F.col("source_event_id").isNotNull(), F.col("supersedes").isNotNull(), F.col("status") == "active"
    same = (F.col("_os") == "active") & (F.col("_k") == F.col("fact_key")) & (F.col("_oscope") == F.col("scope")) & (F.col("_osid") == F.col("scope_id"))
    holds = F.col("_fs").isin("active", "superseded") & (F.col("_ff") <= now) & (F.col("_ft").isNull() | (F.col("_ft") > now))
    refused = reasons(
        (derived & (F.coalesce("_status", F.lit("")) != "active"), "source event is missing, retracted or in another project"),
        (derived & ((F.col("_s") != F.col("scope")) | (F.col("_sid") != F.col("scope_id"))), "derived memory must retain source scope"),
        (derived & F.col("_fs").isNotNull() & ~holds, "source fact is not currently valid"),
        (active & follows & ~F.coalesce(same, F.lit(False)), "superseded fact must be active with the same key and scope"),
        (active & follows & same & (F.col("valid_from") < F.col("_of")), "supersession cannot precede the previous valid_from"),
        (active & ~follows & F.col("_held"), "active fact already exists in this scope"),
    )
    return rows.withColumn("refused", refused).select(*new.columns, "refused")


def supersede(facts: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new assertions, refused) of changes (project_id, old_fact_id, value_json, valid_from, confidence).

    A successor has its predecessor's key, scope and conditions; its idempotency key binds it to the value.
    """
    old = facts.select("project_id", F.col("fact_id").alias("old_fact_id"), "fact_key", "scope", "scope_id", "conditions_json", F.col("status").alias("_old"))
    rows = changes.join(old, ["project_id", "old_fact_id"], "left").withColumn("refused", reasons((F.col("_old").isNull(), "fact not found in current project"), (F.col("_old") != "active", "only an active fact can be superseded")))
    made = rows.where(F.size("refused") == 0).select(
        "project_id", "fact_key", "scope", "scope_id", "conditions_json", "value_json", "valid_from", "confidence", F.col("old_fact_id").alias("supersedes"), F.lit("active").alias("status"),
        F.concat(F.lit("supersede:"), "old_fact_id", F.lit(":"), F.sha2("value_json", 256)).alias("idempotency_key"),
    )
    return first_by(made, ["project_id", "idempotency_key"], "valid_from"), rows.where(F.size("refused") > 0).select(*changes.columns, "refused")


def resolve_targets(events: DataFrame, facts: DataFrame, targets: DataFrame) -> DataFrame:
    """(project_id, target_id, event_id): an event of that id, else the event that asserts the fact of that id."""
    named = events.select("project_id", F.col("event_id").alias("target_id"), "event_id", F.lit(0).alias("_p"))
    stated = facts.select("project_id", F.col("fact_id").alias("target_id"), F.col("assertion_event_id").alias("event_id"), F.lit(1).alias("_p"))
    hit = named.union(stated).join(targets.select("project_id", "target_id").distinct(), ["project_id", "target_id"])
    return hit.groupBy("project_id", "target_id").agg(F.min_by("event_id", F.struct("_p", "event_id")).alias("event_id"))


def missing_members(markers: DataFrame, seen: DataFrame, deleted: DataFrame) -> DataFrame:
    """(batch_id, event_id) that a commit marker lists and that neither exist nor were deleted."""
    listed = markers.select("batch_id", F.explode("event_ids").alias("event_id")).distinct()
    return listed.join(seen.select("event_id"), "event_id", "left_anti").join(deleted.select(F.col("deleted_id").alias("event_id")), "event_id", "left_anti")


def record_deletion(events: DataFrame, facts: DataFrame, candidates: DataFrame, project: str, target_id: str) -> DataFrame:
    """(deleted_id, what) of a purge: the target's lineage, the facts it asserts, the candidates it came from, and whatever
    else was written for these candidates or derived from the lineage without being committed."""
    e = events.where(F.col("project_id") == project)
    f = facts.where(F.col("project_id") == project)
    start = resolve_targets(e, f, e.sparkSession.createDataFrame([(project, target_id)], "project_id string, target_id string")).select("event_id")
    ids = closure(start, lineage_edges(e, f).select("src", "dst"), "event_id").where(~F.col("event_id").startswith("candidate:"))
    parts = F.split("idempotency_key", ":")
    unit = F.when(F.col("idempotency_key").rlike("^candidate-(summary|fact):"), F.get(parts, 1))
    own = candidates.where(F.col("project_id") == project).select("candidate_id").join(e.join(ids, "event_id", "left_semi").select(unit.alias("candidate_id")), "candidate_id", "left_semi")
    loose = e.join(own.select(F.col("candidate_id").alias("batch_id")), "batch_id", "left_semi").select("event_id").union(e.join(ids.select(F.col("event_id").alias("source_event_id")), "source_event_id", "left_semi").select("event_id"))
    every = ids.union(loose).distinct()
    tagged = lambda df, c, what: df.select(F.col(c).alias("deleted_id"), F.lit(what).alias("what"))
    return tagged(every, "event_id", "event").union(tagged(f.join(every, f.assertion_event_id == every.event_id, "left_semi"), "fact_id", "fact")).union(tagged(own, "candidate_id", "candidate")).distinct()


# -- candidates


def submit(candidates: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(added, refused) of new (project_id, payload_json, idempotency_key, created_at).

    Without a key the payload's digest is the key. The first of a key counts, and none if the project has the key.
    """
    rows = new.withColumn("idempotency_key", F.coalesce(F.nullif("idempotency_key", F.lit("")), F.sha2("payload_json", 256))).withColumn("refused", reasons((has_secret(F.col("payload_json")), "secret")))
    sound = first_by(rows.where(F.size("refused") == 0).drop("refused"), ["project_id", "idempotency_key"], "created_at", "payload_json")
    added = sound.join(candidates.select("project_id", "idempotency_key").distinct(), ["project_id", "idempotency_key"], "left_anti")
    named = F.concat(F.lit("cand-"), F.substring(F.sha2(F.concat_ws("\x1f", "project_id", "idempotency_key"), 256), 1, 32))
    added = added.select(named.alias("candidate_id"), "project_id", "payload_json", F.lit("pending").alias("state"), F.lit("").alias("reason"), "idempotency_key", "created_at", F.col("created_at").alias("updated_at"))
    return added, rows.where(F.size("refused") > 0)


def pending(candidates: DataFrame, limit: int = 20) -> DataFrame:
    """The queue: the oldest pending candidates."""
    return candidates.where("state = 'pending'").orderBy("created_at", "candidate_id").limit(limit)


def override(decided: DataFrame, matches: DataFrame, action: str = "review") -> DataFrame:
    """States after the near-duplicate check of validated candidates.

    matches: (candidate_id, position, candidate_fact_key, fact_id, fact_key, similarity), one a fact at most. A match
    sends a candidate to review, unless matches are to be skipped, or superseded and all have the same key.
    """
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    m = F.struct("position", "candidate_fact_key", "fact_id", "fact_key", "similarity")
    line = lambda x: F.format_string("fact[%d] %s ~ active fact %s (%s), similarity %.4f", x["position"], x["candidate_fact_key"], x["fact_id"], x["fact_key"], x["similarity"])
    found = matches.groupBy("candidate_id").agg(F.sort_array(F.collect_list(m)).alias("_m"), F.bool_and(F.col("fact_key") == F.col("candidate_fact_key")).alias("_same"))
    rows = decided.join(found, "candidate_id", "left")
    stop = (F.col("state") == "validated") & F.col("_m").isNotNull()
    stop = F.lit(False) if action == "skip" else stop & ~F.col("_same") if action == "supersede" else stop
    why = "near-duplicate with another key cannot be superseded" if action == "supersede" else "suspected near-duplicate of existing memory"
    text = F.concat(F.lit(f"{why}: "), F.array_join(F.transform("_m", line), "; "))
    return rows.withColumn("reason", F.when(stop, text).otherwise(F.col("reason"))).withColumn("state", F.when(stop, "needs_confirmation").otherwise(F.col("state"))).drop("_m", "_same")


def consolidate(decided: DataFrame, facts: DataFrame, matches: DataFrame, action: str = "review") -> tuple[DataFrame, DataFrame]:
    """(results, fact writes): what becomes of candidates (candidate_id, state, reason) and of their facts.

    facts: (candidate_id, position, fact_key, supersedes). Only validated candidates write; facts that name what they
    supersede are not held against near duplicates. A skipped duplicate isn't written, a superseding one names its match.
    """
    open_facts = facts.where(blank("supersedes")).select("candidate_id", "position")
    matches = matches.join(open_facts, ["candidate_id", "position"], "left_semi")
    states = override(decided, matches, action)
    ready = states.where("state = 'validated'").select("candidate_id")
    hit = matches.select("candidate_id", "position", F.col("fact_id").alias("_hit"))
    writes = facts.join(ready, "candidate_id", "left_semi").join(hit, ["candidate_id", "position"], "left")
    skipped = F.col("_hit").isNotNull() & F.lit(action == "skip")
    named = F.when(F.col("_hit").isNotNull() & F.lit(action == "supersede"), F.col("_hit")).otherwise(F.coalesce("supersedes", F.lit("")))
    writes = writes.select("candidate_id", "position", "fact_key", named.alias("supersedes"), (~skipped).alias("written"), (F.col("_hit").isNotNull() & F.lit(action == "supersede")).alias("_auto"))
    counts = writes.groupBy("candidate_id").agg(F.count_if(~F.col("written")).alias("skipped"), F.count_if("_auto").alias("superseded"))
    done = F.col("state") == "validated"
    note = F.concat(
        F.lit(MOVED),
        F.when(F.col("skipped") > 0, F.format_string("; %d near-duplicate fact(s) skipped, existing fact kept", "skipped")).otherwise(""),
        F.when(F.col("superseded") > 0, F.format_string("; %d near-duplicate fact(s) auto-superseded", "superseded")).otherwise(""),
    )
    results = states.join(counts, "candidate_id", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("skipped", "superseded")})
    results = results.withColumn("reason", F.when(done, note).otherwise(F.col("reason"))).withColumn("state", F.when(done, "active").otherwise(F.col("state")))
    return results, writes.where("written").drop("written", "_auto")


def finish(candidates: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The candidates with their results (candidate_id, state, reason, read_state, read_at): a row that has changed since it
    was read keeps what it has; results of candidates that are gone change nothing."""
    r = results.select("candidate_id", F.col("state").alias("_state"), F.col("reason").alias("_reason"), "read_state", "read_at")
    rows = candidates.join(r, "candidate_id", "left")
    same = F.col("_state").isNotNull() & (F.col("state") == F.col("read_state")) & (F.col("updated_at") == F.col("read_at"))
    pick = lambda new, old: F.when(same, new).otherwise(F.col(old))
    return rows.withColumns({"state": pick(F.col("_state"), "state"), "reason": pick(F.col("_reason"), "reason"), "updated_at": pick(now, "updated_at")}).select(*candidates.columns)


def review(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """(candidate_id, state, reason, refused) of decisions (project_id, candidate_id, decision, evidence_valid).

    Approval goes back into the queue and needs evidence that can be verified.
    """
    rows = decisions.join(candidates.select("project_id", "candidate_id", F.col("state").alias("_state")), ["project_id", "candidate_id"], "left")
    approve = F.col("decision") == "approve"
    refused = reasons(
        (~F.coalesce(F.col("decision").isin("approve", "reject"), F.lit(False)), "decision must be approve or reject"),
        (F.col("_state").isNull(), "candidate not found in current project"),
        (~F.col("_state").isin("pending", "needs_confirmation"), "candidate is not awaiting review"),
        (approve & ~F.coalesce("evidence_valid", F.lit(False)), "approval requires verifiable evidence"),
    )
    ok = F.size("refused") == 0
    state = F.when(ok, F.when(approve, "pending").otherwise("rejected")).otherwise(F.col("_state"))
    return rows.withColumn("refused", refused).select("candidate_id", state.alias("state"), F.when(ok, F.when(approve, APPROVED).otherwise(REJECTED)).alias("reason"), "refused")


# -- projects, aliases, legacy notes, requests


def upsert(table: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The table with the new rows: of a key the last by ``at`` stays, a new row before an old one of the same time."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    others = [c for c in table.columns if c not in (*keys, at)]
    return first_by(rows, keys, F.desc(at), F.desc("_new"), *others).drop("_new")


def add_alias(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases (alias_path, project_id, active, created_at) with new ones, which take over their path and are active."""
    return upsert(aliases, new.withColumn("active", F.lit(True)), ["alias_path"], "created_at")


def project_of(paths: DataFrame, aliases: DataFrame, projects: DataFrame) -> DataFrame:
    """The project of each path that is an active alias."""
    live = aliases.where("active").select(F.col("alias_path").alias("path"), "project_id")
    return paths.select("path").join(live, "path").join(projects, "project_id")


def to_migrate(files: DataFrame, events: DataFrame) -> DataFrame:
    """Legacy files (path, source_hash) that no event has in this version."""
    known = events.select(F.col("source_legacy_path").alias("path"), "source_hash").where("path IS NOT NULL").distinct()
    return files.join(known, ["path", "source_hash"], "left_anti")


def add_messages(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Messages (user_id, request_id, index, body) to append: once for each (user, request, index), blank ones never."""
    key = F.concat_ws(":", F.lit("add"), F.sha2(F.concat_ws("\x1f", "user_id", "request_id"), 256), F.col("index").cast("string"))
    rows = requests.where(~blank("body")).withColumn("idempotency_key", key)
    return first_by(rows, ["idempotency_key"], "body").join(log.select("idempotency_key").distinct(), "idempotency_key", "left_anti")


def source_events(hits: DataFrame, events: DataFrame) -> DataFrame:
    """The original message behind each hit (query_id, position, source_event_id, scope, scope_id): active, no assertion, no
    operation, of the hit's scope; each event once, for its best hit."""
    live = events.where("kind <> 'fact' AND status = 'active' AND coalesce(operation, '') = ''").select(F.col("event_id").alias("source_event_id"), "scope", "scope_id", "body", "observed_at")
    found = hits.join(live, ["source_event_id", "scope", "scope_id"])
    return first_by(found, ["query_id", "source_event_id"], "position").select("query_id", "position", F.col("source_event_id").alias("event_id"), "body", "observed_at")
