"""Retrieval and question-answering metrics as aggregations."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def score_evidence(rows: DataFrame) -> DataFrame:
    """Flags and recalls from arrays gold, retrieved, retained, forbidden and foreign (retained out of scope)."""
    hits = F.array_intersect("gold", "retained")
    n_gold, n_hits = F.size(F.array_distinct("gold")), F.size(hits)
    answerable = n_gold > 0
    flag = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    failures = F.concat(
        flag(~answerable & (F.size("retained") > 0), "unanswerable_false_retrieval"),
        flag(answerable & (n_hits == 0), "recall_miss"),
        flag(answerable & (n_hits > 0) & (n_hits < n_gold), "incomplete_evidence"),
        flag(F.size(F.array_except(F.array_intersect("gold", "retrieved"), "retained")) > 0, "context_budget_drop"),
        flag(F.size("foreign") > 0, "scope_error"),
        flag(F.size(F.array_intersect("retained", "forbidden")) > 0, "forbidden_time_evidence"),
    )
    return rows.select(
        "*",
        answerable.alias("answerable"),
        F.when(answerable, n_hits / n_gold).alias("evidence_recall"),
        F.when(answerable, F.size(F.array_intersect("gold", "retrieved")) / n_gold).alias("retrieval_recall"),
        (answerable & (n_hits == n_gold)).alias("full_coverage"),
        (~answerable & (F.size("retained") > 0)).alias("false_retrieval"),
        F.sort_array(failures).alias("failures"),
    )


def macro(scored: DataFrame, *by: str) -> DataFrame:
    """Macro averages over answerable questions, rates over the others."""
    a = F.col("answerable")
    rate = lambda c, test: F.round(F.avg(F.when(test, F.col(c).cast("double"))), 6)
    return scored.groupBy(*by).agg(
        F.count("*").alias("questions"),
        F.count_if(a).alias("answerable"),
        F.count_if(~a).alias("unanswerable"),
        rate("evidence_recall", a).alias("evidence_recall_macro"),
        rate("retrieval_recall", a).alias("retrieval_recall_macro"),
        rate("full_coverage", a).alias("full_coverage_rate"),
        rate("false_retrieval", ~a).alias("false_retrieval_rate"),
    )


def failure_counts(scored: DataFrame, *by: str) -> DataFrame:
    return scored.select(*by, F.explode("failures").alias("failure")).groupBy(*by, "failure").agg(F.count("*").alias("n"))


def percentile(value: str, p: float) -> Column:
    """Linear interpolation between neighbours, rounded to 6 places."""
    return F.round(F.percentile(value, F.lit(p)), 6)


def exact_percentiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float], accuracy: int = 10_000, between: bool = True) -> DataFrame:
    """Percentiles by group, exact, without all values of a group in one place: linear between neighbours, rounded to 6
    places, or the value at place floor(n * p), the last one at most.

    A sketch brackets each percentile; values below a bracket are only counted, and the few within it are kept with their
    counts. A bracket of a group of n values holds about 4 n / accuracy of them.
    """
    some = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    at = lambda p: F.lit(min(1.0, max(0.0, p)))
    cuts = []
    for name, p in points.items():
        cuts += [F.percentile_approx("_v", at(p - 2 / accuracy), accuracy).alias(f"_lo_{name}"), F.percentile_approx("_v", at(p + 2 / accuracy), accuracy).alias(f"_hi_{name}")]
    bounds = some.groupBy(*by).agg(F.count("*").alias("_n"), *cuts)
    joined = some.join(bounds, by) if by else some.crossJoin(bounds)
    parts = []
    for name in points:
        # one value more on each side of the bracket, for the interpolation
        low, high = F.col("_v") < F.col(f"_lo_{name}"), F.col("_v") > F.col(f"_hi_{name}")
        parts += [F.count_if(low).alias(f"_below_{name}"), F.max(F.when(low, F.col("_v"))).alias(f"_under_{name}"), F.min(F.when(high, F.col("_v"))).alias(f"_over_{name}"), F.collect_list(F.when(~low & ~high, F.col("_v"))).alias(f"_in_{name}")]
    got = joined.groupBy(*by).agg(F.first("_n").alias("_n"), *parts)
    out = []
    for name, p in points.items():
        inside = F.array_sort(f"_in_{name}")
        at = (F.col("_n") - 1) * F.lit(p) if between else F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p)))
        place = at - F.col(f"_below_{name}")  # among the values inside

        def pick(i: Column, inside: Column = inside, name: str = name) -> Column:
            k = i.cast("int")
            return F.when(k < 0, F.col(f"_under_{name}")).when(k >= F.size(inside), F.col(f"_over_{name}")).otherwise(F.get(inside, k))

        low, part = pick(F.floor(place)), place - F.floor(place)
        out.append((F.round(F.when(part == 0, low).otherwise(low + (pick(F.floor(place) + 1) - low) * part), 6) if between else low).alias(name))
    return got.select(*by, *out)


READER = T.StructType([T.StructField("answer", T.StringType()), T.StructField("abstained", T.BooleanType()), T.StructField("citations", T.ArrayType(T.StringType())), T.StructField("flags", T.ArrayType(T.StringType()))])


def read_output(text: str | None, sources: list[str]) -> tuple:
    """Strict: exactly answer, abstained and citations, no key twice."""

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key twice")
        return dict(pairs)

    try:
        got = json.loads(text, object_pairs_hook=once)
        answer, abstained, cited = (got[k] for k in ("answer", "abstained", "citations"))
        if len(got) != 3 or not isinstance(answer, str) or not isinstance(abstained, bool) or not isinstance(cited, list) or not all(isinstance(c, str) and c for c in cited):
            raise ValueError("types")
    except (ValueError, TypeError, KeyError):
        fenced = isinstance(text, str) and re.fullmatch(r"\s*```(?:json)?\s*\n[\s\S]*\n```\s*", text)
        return None, None, None, ["format_error"] + (["markdown_wrapper"] if fenced else [])
    tests = [
        ("duplicate_citation", len(set(cited)) < len(cited)),
        ("unknown_citation", not set(cited) <= set(sources)),
        ("inconsistent_abstention", abstained and bool(answer.strip() or cited)),
        ("empty_answer_without_abstention", not abstained and not answer.strip()),
        ("answer_without_citations", not abstained and not cited),
        ("answer_without_evidence", not abstained and not sources),
    ]
    return answer, abstained, cited, [name for name, hit in tests if hit]


def parse_reader(text: Column, sources: Column) -> Column:
    @pandas_udf(READER)
    def parse(t: pd.Series, s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_output(x, list(y) if y is not None else []) for x, y in zip(t, s)], columns=READER.names)

    return parse(text, sources)


TRUNCATED = ["length", "max_tokens", "max_output_tokens"]


def score_answers(cases: DataFrame) -> DataFrame:
    """cases: text, source_ids, gold, accepted, unanswerable, error_type, finish_reason -> flags and outcomes."""
    from ..functions.text import normal_answer

    rows = cases.withColumn("r", parse_reader(F.col("text"), F.col("source_ids"))).withColumn("said", normal_answer(F.col("r.answer")))
    accepted = rows.select("question_id", "baseline", F.explode("accepted").alias("a")).withColumn("a", normal_answer(F.col("a"))).groupBy("question_id", "baseline").agg(F.collect_set("a").alias("norms"))
    rows = rows.join(accepted, ["question_id", "baseline"], "left")
    parsed = F.col("r.abstained").isNotNull()
    abstained = parsed & F.col("r.abstained")
    failed = F.coalesce("error_type", F.lit("")) != ""
    cut = F.coalesce("finish_reason", F.lit("")).isin(TRUNCATED)
    sound = ~failed & ~cut
    contract = F.size("r.flags") == 0
    absent = F.col("unanswerable")
    right = abstained & contract & sound & absent
    exact = F.when(absent, right).otherwise(parsed & ~abstained & F.coalesce(F.array_contains("norms", F.col("said")), F.lit(False)) & sound)
    cited = F.size(F.array_intersect(F.coalesce("r.citations", F.array().cast("array<string>")), "gold")) > 0
    flag = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    flags = F.concat(
        "r.flags", flag(failed, "reader_error"), flag(cut, "output_truncated"), flag(parsed & absent & ~abstained, "answered_unanswerable_question"),
        flag(parsed & ~absent & abstained, "answerable_question_refused"), flag(parsed & ~absent & ~abstained & ~cited, "no_gold_source_cited"),
    )
    return rows.select(
        "question_id", "baseline", (~absent).alias("answerable"), F.sort_array(F.array_distinct(flags)).alias("flags"), parsed.alias("format_valid"), (contract & sound).alias("contract_valid"),
        (parsed & ~abstained).alias("answered"), exact.alias("exact_match"), right.alias("correct_abstention"),
    )


def rubric_points(answers: DataFrame, rubrics: DataFrame) -> DataFrame:
    """(question_id, baseline, hit, points, forbidden, passed): required points and forbidden claims of a lexical rubric.

    answers: question_id, baseline, answer (null or empty if there is none). rubrics: question_id, required
    array<struct<id, any_of>>, forbidden array<struct<id, patterns>>; patterns are matched without regard to case.
    """
    from ..functions.text import normal_answer

    words = rubrics.select("question_id", F.explode("required").alias("r")).select("question_id", "r.id", F.explode("r.any_of").alias("w")).withColumn("w", normal_answer(F.col("w")))
    needed = words.groupBy("question_id", "id").agg(F.collect_set("w").alias("w")).groupBy("question_id").agg(F.collect_list(F.struct("id", "w")).alias("req"))
    rows = answers.withColumn("said", normal_answer(F.coalesce("answer", F.lit("")))).join(needed, "question_id").join(rubrics.select("question_id", "forbidden"), "question_id")
    there = F.col("said") != ""
    hit = F.size(F.filter("req", lambda r: there & F.exists(r["w"], lambda w: F.col("said").contains(w))))
    bad = F.transform(F.filter("forbidden", lambda c: there & F.exists(c["patterns"], lambda p: F.regexp_like("answer", F.concat(F.lit("(?i)"), p)))), lambda c: c["id"])
    bad = F.coalesce(bad, F.array().cast("array<string>"))
    return rows.select("question_id", "baseline", hit.alias("hit"), F.size("req").alias("points"), bad.alias("forbidden"), (there & (hit == F.size("req")) & (F.size(bad) == 0)).alias("passed"))


def summary(scored: DataFrame, expected: DataFrame, *by: str) -> DataFrame:
    """Rates over the expected cases, not over those that came back.

    expected: the columns of ``by``, expected, expected_answerable, expected_unanswerable; groups of which nothing came back
    are there with zeros. scored may have recall (of the gold sources), complete (all gold sources whole), input_tokens,
    output_tokens, hit, points and passed of a rubric.
    """
    has = lambda c: c in scored.columns
    n = lambda test, name: F.count_if(test).alias(name)
    flagged = lambda name: F.array_contains("flags", name)
    total = [F.sum(c).alias(f"{c}_total") for c in ("input_tokens", "output_tokens") if has(c)]
    gold = [F.sum(F.when(F.col("answerable"), F.col("recall"))).alias("_recall"), n(F.col("answerable") & F.col("complete"), "_complete")] if has("recall") else []
    rubric = [F.count("passed").alias("rubric_cases"), n("passed", "_passed"), F.sum(F.col("hit") / F.col("points")).alias("_points")] if has("passed") else []
    got = scored.groupBy(*by).agg(
        F.count("*").alias("_done"), n("exact_match", "_exact"), n(F.col("exact_match") & F.col("contract_valid"), "_contract"), n(F.col("exact_match") & F.col("answerable"), "_right"),
        n("correct_abstention", "_abstained"), n(F.col("answerable") & flagged("answerable_question_refused"), "_refused"), n("answered", "_answered"), n(~F.col("format_valid"), "_format"), *total, *gold, *rubric,
    )
    rows = expected.join(got, list(by), "left") if by else expected.crossJoin(got)
    count = lambda c: F.coalesce(c, F.lit(0))
    rate = lambda c, of, name: F.round(F.when(F.col(of) > 0, count(c) / F.col(of)), 6).alias(name)
    out = [
        F.col("expected"), count("_done").alias("completed"), (F.col("expected") - count("_done")).alias("pending"), F.col("expected_answerable"), F.col("expected_unanswerable"),
        rate("_exact", "expected", "exact_match_rate"), rate("_contract", "expected", "contract_exact_match_rate"), rate("_right", "expected_answerable", "answerable_exact_match"),
        rate("_abstained", "expected_unanswerable", "abstention_accuracy"), rate("_refused", "expected_answerable", "refusal_rate"), rate("_answered", "expected", "answer_rate"), rate("_format", "expected", "format_failure_rate"),
    ]
    out += [rate("_recall", "expected_answerable", "recall_macro"), rate("_complete", "expected_answerable", "complete_coverage")] if gold else []
    out += [count("rubric_cases").alias("rubric_cases"), rate("_passed", "rubric_cases", "rubric_pass_rate"), rate("_points", "rubric_cases", "rubric_point_coverage")] if rubric else []
    return rows.select(*by, *out, *[count(f"{c}_total").alias(f"{c}_total") for c in ("input_tokens", "output_tokens") if has(c)])


def flag_counts(scored: DataFrame, *by: str) -> DataFrame:
    return scored.select(*by, F.explode("flags").alias("flag")).groupBy(*by, "flag").agg(F.count("*").alias("n"))


def expected_cases(questions: DataFrame, *by: str) -> DataFrame:
    """Denominators of ``summary`` from questions with a column unanswerable."""
    absent = F.coalesce("unanswerable", F.lit(False))
    return questions.groupBy(*by).agg(F.count("*").alias("expected"), F.count_if(~absent).alias("expected_answerable"), F.count_if(absent).alias("expected_unanswerable"))


def run_summary(scored: DataFrame, questions: DataFrame, baselines: DataFrame) -> DataFrame:
    """A run's summary by baseline, and by baseline and category (category null: all)."""
    every = questions.select("question_id", "category", "unanswerable")
    rows = scored.join(every.select("question_id", "category"), "question_id")
    whole = baselines.join(expected_cases(every))
    parts = baselines.join(expected_cases(every, "category"))
    return summary(rows, whole, "baseline").unionByName(summary(rows, parts, "baseline", "category"), allowMissingColumns=True)


def reader_matches(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: exact match of outside predictions without regard to white space and case, over all questions.

    questions: question_id, unanswerable, accepted; predictions: question_id, hypothesis, abstained, one a question.
    """
    from ..functions.text import folded

    rows = questions.join(predictions, "question_id", "left").withColumn("_said", folded(F.col("hypothesis"))).withColumn("_ok", F.split(folded(F.array_join("accepted", "\x00")), "\x00"))
    absent = F.coalesce("unanswerable", F.lit(False))
    abstained = F.coalesce("abstained", F.lit(False))
    hit = F.when(absent, abstained).otherwise(~abstained & F.coalesce(F.array_contains("_ok", F.col("_said")), F.lit(False)))
    n, m = F.count("*"), F.count_if(absent)
    return rows.agg(
        n.alias("questions"), F.count_if(F.col("hypothesis").isNull()).alias("missing_predictions"), F.round(F.when(n > 0, F.count_if(hit) / n), 6).alias("normalized_exact_match"),
        F.round(F.when(m > 0, F.count_if(hit & absent) / m), 6).alias("explicit_abstention_accuracy"),
    )


def prediction_faults(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """(question_id, fault): predictions that are repeated, of no question, or without a text."""
    known = questions.select("question_id").distinct().withColumn("_known", F.lit(True))
    n = predictions.groupBy("question_id").agg(F.count("*").alias("_n"), F.count("hypothesis").alias("_h")).join(known, "question_id", "left")
    fault = F.when(F.col("_known").isNull(), "unknown").when(F.col("_n") > 1, "duplicate").when(F.col("_h") < F.col("_n"), "incomplete")
    return n.select("question_id", fault.alias("fault")).where("fault IS NOT NULL")


CASE = ["baseline", "question_id"]


def import_grades(predictions: DataFrame, grades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accuracy by baseline, faults) of independent grades (baseline, question_id, correct, prediction_sha256)."""
    n = grades.groupBy(*CASE).agg(F.count("*").alias("_n"))
    rows = grades.join(n, CASE).join(predictions.select(*CASE, F.col("record_sha256").alias("_p")), CASE, "left")
    fault = F.when(F.col("_p").isNull(), "unknown").when(F.col("_n") > 1, "duplicate").when(F.col("correct").isNull(), "not a verdict").when(F.col("_p") != F.col("prediction_sha256"), "changed")
    rows = rows.withColumn("fault", fault)
    good = rows.where("fault IS NULL").groupBy("baseline").agg(F.count("*").alias("graded_cases"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))
    return good, rows.where("fault IS NOT NULL").select(*CASE, "fault")


def record_digest(rows: DataFrame, *columns: str) -> Column:
    """SHA-256 of the columns' JSON, in the order given."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def resume(cases: DataFrame, predictions: DataFrame, run: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bound, faults, remaining): predictions of this run that belong to a case as it is now, those that don't, and the
    cases still to be answered. Both have baseline, question_id, messages_sha256, sources_sha256; predictions also
    run_fingerprint, record_sha256 and digest (what record_sha256 should be)."""
    now = cases.select(*CASE, F.col("messages_sha256").alias("_m"), F.col("sources_sha256").alias("_s"))
    n = predictions.groupBy(*CASE).agg(F.count("*").alias("_n"))
    rows = predictions.join(n, CASE).join(now, CASE, "left")
    fault = (
        F.when(F.col("_m").isNull(), "unknown").when(F.col("_n") > 1, "duplicate").when(~F.col("run_fingerprint").eqNullSafe(F.lit(run)), "other run")
        .when((F.col("_m") != F.col("messages_sha256")) | (F.col("_s") != F.col("sources_sha256")), "other case").when(~F.col("record_sha256").eqNullSafe(F.col("digest")), "changed")
    )
    rows = rows.withColumn("fault", fault)
    bound = rows.where("fault IS NULL").select(*predictions.columns)
    return bound, rows.where("fault IS NOT NULL").select(*CASE, "fault"), cases.join(bound.select(*CASE), CASE, "left_anti")


def rubric_faults(rubrics: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, fault): rubrics that are repeated, of no question, or without an id."""
    known = questions.select("question_id").distinct().withColumn("_known", F.lit(True))
    n = rubrics.groupBy("question_id").agg(F.count("*").alias("_n")).join(known, "question_id", "left")
    fault = F.when(F.coalesce("question_id", F.lit("")) == "", "missing id").when(F.col("_n") > 1, "duplicate").when(F.col("_known").isNull(), "unknown")
    return n.select("question_id", fault.alias("fault")).where("fault IS NOT NULL")


def span_faults(spans: DataFrame, questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(question_id, fault) of gold spans (question_id, evidence_id, source_id, start, end, quote_sha256).

    Every span must lie in a source of the question's project and scope and have the digest it names; an answerable question
    has spans in all its required sources and no others, an unanswerable one has none.
    """
    home = ["project", "scope", "scope_id"]
    q = questions.select("question_id", F.coalesce("unanswerable", F.lit(False)).alias("_absent"), F.array_sort(F.array_distinct("required_source_ids")).alias("_need"), *[F.col(c).alias(f"_{c}") for c in home])
    s = sources.select("source_id", "body", *home, F.lit(True).alias("_there"))
    placed = spans.join(q, "question_id", "left").join(s, "source_id", "left")
    inside = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("body"))
    quote = F.sha2(F.substring(F.col("body"), F.col("start") + 1, F.col("end") - F.col("start")), 256)
    same = F.lit(True)
    for c in home:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    each = placed.withColumn("fault", F.when(F.col("_need").isNull(), "unknown question").when(F.col("_there").isNull() | ~same, "source out of scope").when(~inside, "range").when(quote != F.col("quote_sha256"), "quote"))
    twice = spans.groupBy("question_id", "evidence_id").agg(F.count("*").alias("n")).where("n > 1 OR coalesce(evidence_id, '') = ''").select("question_id", F.lit("evidence id").alias("fault"))
    got = spans.groupBy("question_id").agg(F.array_sort(F.collect_set("source_id")).alias("_got"))
    cover = q.join(got, "question_id", "left")
    miss = cover.withColumn("fault", F.when(F.col("_absent") & F.col("_got").isNotNull(), "spans of an unanswerable question").when(~F.col("_absent") & F.col("_got").isNull(), "no spans").when(~F.col("_absent") & (F.col("_got") != F.col("_need")), "other sources than required"))
    return each.select("question_id", "fault").union(twice).union(miss.select("question_id", "fault")).where("fault IS NOT NULL").distinct()


PAYLOAD = "struct<sources: array<struct<source_id: string, body: string>>>"


def presented_records(cases: DataFrame) -> DataFrame:
    """(baseline, question_id, source_id, body) that a case's payload (JSON) really shows; an id shown twice doesn't count."""
    rows = cases.select(*CASE, F.explode(F.from_json("payload", PAYLOAD)["sources"]).alias("r")).select(*CASE, "r.*").where("source_id IS NOT NULL AND body IS NOT NULL")
    return rows.groupBy(*CASE, "source_id").agg(F.count("*").alias("n"), F.first("body").alias("body")).where("n = 1").drop("n")


NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Name-based UUID: SHA-1 of the namespace's bytes and the name, with version 5 and the RFC variant."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


SOURCE_FIELDS = ["source_id", "project", "title", "body", "tags", "scope", "scope_id", "observed_at", "split"]


def ingest_sources(sources: DataFrame, prefix: str = "eval:") -> DataFrame:
    """Event rows of evaluation sources, which may hold nothing but sources, with ids bound to the sources' ids."""
    if unknown := sorted(set(sources.columns) - set(SOURCE_FIELDS)):
        raise ValueError(f"only source records may enter: {', '.join(unknown)}")
    has = lambda c, other: F.coalesce(c, F.lit(other)) if c in sources.columns else F.lit(other)
    at = has("observed_at", "2025-01-01T00:00:00Z").cast("timestamp")
    return sources.select(
        uuid5(F.concat(F.lit(prefix), "source_id")).alias("event_id"), F.col("project").alias("project_id"), "source_id", "title", F.btrim("body").alias("body"), has("scope", "project").alias("scope"), has("scope_id", "").alias("scope_id"),
        at.alias("observed_at"), at.alias("recorded_at"), F.concat(F.lit("eval-source:"), "source_id").alias("idempotency_key"),
    )


def reader_cases(hits: DataFrame, budget: int, packing: str = "full") -> DataFrame:
    """(question_id, baseline, source_ids, complete_source_ids, payload, n_bytes): what a reader is given.

    hits: question_id, baseline, question, position, source_id, title, body. In order of position a source goes in whole if
    the payload stays within the budget of UTF-8 bytes; with ``excerpt`` packing a part of it otherwise, of an equal share
    of what is left. A case's hits are bounded by the search limit.
    """
    from ..sources.events import canonical
    from .context import excerpt, size

    if packing not in ("full", "excerpt"):
        raise ValueError(f"unknown packing {packing!r}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position").drop_duplicates("source_id")
        question = pdf["question"].iloc[0]
        render = lambda some: canonical({"question": question, "sources": some})
        shown: list[dict] = []
        whole: list[str] = []
        for i, r in enumerate(pdf.to_dict("records")):
            record = {"source_id": r["source_id"], "title": r["title"], "body": r["body"], "excerpted": False}
            slot = 0
            if size(render([*shown, record])) > budget and packing == "excerpt":
                slot = max(0, (budget - size(render(shown))) // (len(pdf) - i) - 180)
            while size(render([*shown, record])) > budget and slot >= 12:
                part = excerpt(r["body"], question, slot)
                record |= {"body": part, "excerpted": part != r["body"]}
                slot -= 12
            if record["body"] and size(render([*shown, record])) <= budget:
                shown.append(record)
                whole += [] if record["excerpted"] else [record["source_id"]]
        text = render(shown)
        ids = [x["source_id"] for x in shown]
        return pd.DataFrame([(pdf["question_id"].iloc[0], pdf["baseline"].iloc[0], ids, whole, text, size(text))], columns=["question_id", "baseline", "source_ids", "complete_source_ids", "payload", "n_bytes"])

    return hits.groupBy("question_id", "baseline").applyInPandas(run, "question_id string, baseline string, source_ids array<string>, complete_source_ids array<string>, payload string, n_bytes long")


def rebuilt(imported: DataFrame, hits: DataFrame, budget: int, packing: str = "full") -> DataFrame:
    """Imported cases whose payload is what their sources give, and no others: (question_id, baseline, payload, same)."""
    made = reader_cases(hits, budget, packing).select("question_id", "baseline", F.col("payload").alias("_made"))
    return imported.join(made, ["question_id", "baseline"], "left").withColumn("same", F.coalesce(F.col("payload") == F.col("_made"), F.lit(False))).drop("_made")


def span_scores(gold: DataFrame, presented: DataFrame) -> DataFrame:
    """Share of gold spans (question_id, source_id, start, end) that the presented intervals cover whole."""
    from .passages import covered

    key = F.concat_ws("\x1f", "question_id", "source_id").alias("id")
    done = covered(presented.select(key, "start", "end"), gold.select(key, "start", "end"))
    return done.groupBy(F.substring_index("id", "\x1f", 1).alias("question_id")).agg(F.count("*").alias("spans"), F.count_if("covered").alias("hit"), F.round(F.avg(F.col("covered").cast("double")), 6).alias("coverage"))


def acceptance(checks: dict[str, Column], rows: DataFrame) -> DataFrame:
    """One row of boolean gates and whether all hold."""
    every = rows.select(*[c.alias(n) for n, c in checks.items()])
    passed = F.lit(True)
    for n in checks:
        passed = passed & F.col(n)
    return every.withColumn("accepted", passed)
