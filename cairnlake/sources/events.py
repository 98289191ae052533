"""Event files, legacy notes and evaluation datasets as DataFrames, and their writers."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# The closed field set of an event file.
REQUIRED = "schema_version id project_id project_root scope scope_id kind title tags observed_at recorded_at source source_hash visibility created_by idempotency_key".split()
OPTIONAL = "operation target_id source_legacy_path source_event_id entities batch_id".split()
FACT = "fact_id fact_key value status valid_from valid_to retracted_at supersedes confidence verified_at expires_at evidence_kind evidence conditions".split()
KINDS, SCOPES, STATUSES = ["core", "fact", "episode", "procedure", "artifact_ref"], ["global", "project", "session", "agent"], ["active", "superseded", "retracted", "expired"]

PARSED = T.StructType([T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("body", T.StringType()), T.StructField("error", T.StringType())])


def canonical(value: object) -> str:
    """Compact JSON with sorted keys and plain Unicode."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def parse_text(text: str) -> tuple[dict | None, str | None, str | None]:
    """``key: <json>`` lines between two ``---`` lines, then the body. No key twice, none unknown, none missing."""
    lines = text.replace("\r\n", "\n").split("\n")
    if lines[0] != "---" or "---" not in lines[1:]:
        return None, None, "no front matter"
    end = lines.index("---", 1)
    meta: dict[str, str] = {}
    for line in lines[1:end]:
        key, colon, value = line.partition(":")
        if not colon or key in meta:
            return None, None, f"bad or repeated field {key!r}"
        try:
            meta[key] = canonical(json.loads(value))
        except ValueError:
            return None, None, f"field {key!r} is not JSON"
    allowed = {*REQUIRED, *OPTIONAL, *(FACT if meta.get("kind") == '"fact"' else ["conditions"])}
    wrong = sorted((set(REQUIRED) - set(meta)) | (set(meta) - allowed))
    return (None, None, f"missing or unknown fields: {', '.join(wrong)}") if wrong else (meta, "\n".join(lines[end + 1 :]).strip(), None)


def parse_events(text: Column) -> Column:
    @pandas_udf(PARSED)
    def parse(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_text(t) for t in x], columns=PARSED.names)

    return parse(text)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """All event files below a path: file_path, meta, body, error."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    return files.withColumn("e", parse_events(F.col("value"))).select("file_path", "e.*")


def field(name: str) -> Column:
    """A text field of the parsed front matter."""
    return F.from_json(F.concat(F.lit('{"v":'), F.col("meta")[name], F.lit("}")), "v string").getField("v")


def serialize(meta: Column, body: Column) -> Column:
    """Front matter with sorted keys, then the body; meta is a map of JSON texts."""
    lines = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), body, F.lit("\n"))


def event_path(folder: Column, recorded_at: Column, event_id: Column) -> Column:
    return F.concat(F.lit("projects/"), folder, F.lit("/events/"), F.date_format(recorded_at, "yyyy/MM/"), F.date_format(recorded_at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), event_id, F.lit(".md"))


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Legacy notes: ``key: value`` lines between ``---`` lines; those without title, time, project_root and tags are dropped."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("v"))
    parts = files.withColumn("p", F.split("v", r"(?m)^---\s*$", 3)).where("size(p) = 3")
    fields = F.map_from_entries(F.transform(F.filter(F.split(F.col("p")[1], "\n"), lambda x: x.contains(":")), lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1)), F.btrim(F.regexp_replace(x, "^[^:]*:", "")))))
    notes = parts.withColumn("f", fields).select("file_path", *[F.col("f")[k].alias(k) for k in ("title", "time", "project_root", "tags")], F.btrim(F.col("p")[2], F.lit(" \n\r\t")).alias("body"))
    return notes.dropna(subset=["title", "time", "project_root", "tags"])


def violations(meta: DataFrame) -> DataFrame:
    """Adds violations: names of the constraints that a row of typed fields breaks."""
    uuid = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    tests = [
        ("kind", ~F.col("kind").isin(KINDS)),
        ("scope", ~F.col("scope").isin(SCOPES)),
        ("scope_id", F.col("scope").isin("session", "agent") & (F.coalesce("scope_id", F.lit("")) == "")),
        ("id", ~F.col("id").rlike(uuid)),
        ("title", F.coalesce(F.btrim("title"), F.lit("")) == ""),
    ]
    return meta.withColumn("violations", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests])))


def haystack(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation haystacks to sources and questions; labels never enter a source. Repeated session ids keep their place."""
    project = F.concat(F.lit("haystack:"), F.col("question_id"))
    zipped = F.arrays_zip(F.col("haystack_sessions").alias("turns"), F.col("haystack_session_ids").alias("sid"), F.col("haystack_dates").alias("date"))
    rows = records.select("question_id", project.alias("project"), F.posexplode(zipped).alias("at", "s"))
    source_id = F.concat(F.lit("src-"), F.substring(F.sha2(F.concat_ws("\0", "question_id", F.col("at").cast("string"), "s.sid"), 256), 1, 24))
    turns = F.to_json(F.transform("s.turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))))
    sources = rows.select(source_id.alias("source_id"), "question_id", "project", F.col("s.sid").alias("session_id"), F.concat(F.lit("Conversation session "), "s.sid").alias("title"), F.concat(F.lit("Session date: "), "s.date", F.lit("\n"), turns).alias("body"))
    gold = records.select("question_id", F.explode("answer_session_ids").alias("session_id")).distinct().join(sources, ["question_id", "session_id"]).groupBy("question_id").agg(F.sort_array(F.collect_set("source_id")).alias("gold"))
    absent = F.col("question_id").endswith("_abs")
    none = F.array().cast("array<string>")
    questions = records.join(gold, "question_id", "left").select("question_id", project.alias("project"), "question", "answer", F.when(absent, F.lit("abstention")).otherwise(F.col("question_type")).alias("category"), absent.alias("unanswerable"), F.when(absent, none).otherwise(F.coalesce("gold", none)).alias("required_source_ids"))
    return sources.drop("session_id"), questions


def dataset_violations(sources: DataFrame, questions: DataFrame) -> DataFrame:
    """(rule, id): a project in two splits, gold that doesn't exist or crosses projects, answerable without gold."""
    both = sources.select("project", "split").union(questions.select("project", "split")).groupBy("project").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.lit("project in one split").alias("rule"), F.col("project").alias("id"))
    gold = questions.select("question_id", "project", F.explode("required_source_ids").alias("source_id"))
    crossing = gold.join(sources.select("source_id", "project"), ["source_id", "project"], "left_anti").select(F.lit("gold within the project").alias("rule"), F.col("question_id").alias("id"))
    plain = questions.where(F.col("unanswerable") == (F.size("required_source_ids") > 0)).select(F.lit("unanswerable has no gold, others have").alias("rule"), F.col("question_id").alias("id"))
    return both.union(crossing).union(plain)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_notes(notes: DataFrame, path: str) -> None:
    """Legacy notes as text, one file a partition of the writer."""
    notes.select(F.concat(F.lit("---\ntitle: "), "title", F.lit("\ntime: "), F.col("time").cast("string"), F.lit("\nproject_root: "), "project_root", F.lit("\ntags: "), "tags", F.lit("\n---\n"), "body").alias("value")).write.text(path)


def append_usage(runs: DataFrame, path: str) -> None:
    """Telemetry rows; of a query only its digest is stored."""
    runs.withColumn("query_sha256", F.sha2("query", 256)).drop("query").write.mode("append").parquet(path)


def append_shadow(rows: DataFrame, path: str) -> None:
    """Comparisons of two result lists (legacy_refs, refs) with their overlap; of a query only its digest is stored."""
    from ..operators.reports import overlap

    rows.withColumn("query_sha256", F.sha2("query", 256)).withColumn("overlap", overlap(F.col("legacy_refs"), F.col("refs"))).drop("query").write.mode("append").parquet(path)


def to_export(events: DataFrame, since: Column | None = None) -> DataFrame:
    """Legacy notes (project_root, file, title, time, tags, body) of active events that are no operations and were not
    imported from legacy notes, recorded since an instant."""
    from ..functions.text import safe_title

    rows = events.where("status = 'active' AND coalesce(operation, '') = '' AND source <> 'legacy_import'")
    rows = rows if since is None else rows.where(F.col("recorded_at") >= since)
    file = F.concat_ws("-", F.date_format("recorded_at", "yyyy-MM-dd"), safe_title(F.col("title")), F.substring("event_id", 1, 8))
    return rows.select("project_root", F.concat(file, F.lit(".md")).alias("file"), "title", F.col("recorded_at").alias("time"), F.array_join("tags", ",").alias("tags"), "body")


def fingerprint(df: DataFrame) -> str:
    """Digest of a table's rows in any order: their number and the XOR of their SHA-256, in 64-bit parts."""
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.bit_xor(F.conv(F.substring(digest, 1 + 16 * i, 15), 16, 10).cast("long")).alias(f"p{i}") for i in range(4)]
    row = df.agg(F.count("*").alias("n"), *parts).first()
    return ":".join(str(x or 0) for x in row)


def write_dataset(folder: str, sources: DataFrame, questions: DataFrame) -> DataFrame:
    """Write an evaluation dataset, sources and questions by split, and its manifest (name, fingerprint); a folder that holds
    one already is refused by the writer."""
    spark = sources.sparkSession
    splits = [r.split for r in questions.select("split").distinct().orderBy("split").collect()]  # a few names
    parts = {"sources": sources} | {f"questions.{s}": questions.where(F.col("split") == s) for s in splits}
    for name, df in parts.items():
        df.write.mode("error").json(f"{folder}/{name}")
    manifest = spark.createDataFrame([(n, fingerprint(df)) for n, df in parts.items()], "name string, fingerprint string")
    manifest.coalesce(1).write.mode("error").json(f"{folder}/manifest")
    return manifest


def read_dataset(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a dataset, each checked against the manifest; schemas has sources and questions."""
    tables = {}
    for name, said in spark.read.schema("name string, fingerprint string").json(f"{folder}/manifest").collect():  # a row a table
        tables[name] = read_jsonl(spark, f"{folder}/{name}", schemas[name.split(".")[0]])
        if fingerprint(tables[name]) != said:
            raise ValueError(f"{name} differs from the manifest")
    return tables
