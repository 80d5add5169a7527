"""Progress events: normalising, routing, de-duplication, run state.  Each function takes a batch or a streaming DataFrame unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.operators import nested
from lexspark.operators.records import artifacts_of
from lexspark.sources.shared import cut

COMMON = ("type", "trace_id", "component", "created_at", "job_id")
#: (node, status) -> type.  Fixed values.
EVENT_TYPES = {
    ("ingest", "started"): "review.ingest.started",
    ("ingest", "success"): "review.ingest.success",
    ("ingest", "failed"): "review.ingest.failed",
    ("ingest", "format_only"): "review.ingest.format_only",
    ("retrieve_rules", "success"): "review.retrieve.success",
    ("retrieve_rules", "failed"): "review.retrieve.failed",
    ("judge_rules", "skipped"): "review.judge.skipped",
    ("judge_rules", "success"): "review.judge.success",
    ("judge_rules", "failed"): "review.judge.failed",
    ("judge_rules", "empty"): "review.judge.empty",
    ("judge_rules", "deterministic"): "review.judge.deterministic",
    ("judge_rules", "coverage_check"): "review.coverage.completed",
    ("quality_gate", "widen"): "review.quality_gate.widen",
    ("quality_gate", "ok"): "review.quality_gate.ok",
    ("widen_review_scope", "success"): "review.widen.success",
    ("reload_review_rules", "success"): "review.widen.rules_reloaded",
    ("reload_review_rules", "failed"): "review.widen.failed",
    ("format_review", "success"): "review.format.success",
    ("format_review", "skipped"): "review.format.skipped",
    ("format_review", "failed"): "review.format.failed",
    ("aggregate", "success"): "review.aggregate.success",
    ("write_outputs", "success"): "review.report.written",
    ("write_manifest", "success"): "review.manifest.written",
}


def event_type(node, status):
    """Type of a node's event; unknown pairs are review.<node>.<status>."""
    table = F.create_map(*[F.lit(x) for (n, s), t in EVENT_TYPES.items() for x in (f"{n}|{s}", t)])
    return F.coalesce(table[F.concat_ws("|", node, status)], F.concat_ws(".", F.lit("review"), node, status))


def normalize_events(raw: DataFrame) -> DataFrame:
    """Common fields as columns and the rest of ``payload`` (a JSON object) as ``extras``; extras never stand in for a common field."""
    extras = F.map_filter(F.coalesce(F.from_json("payload", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*COMMON))
    return raw.select(*[c for c in ("event_id", *COMMON) if c in raw.columns], extras.alias("extras"))


def route_events(parts: DataFrame) -> DataFrame:
    """(…, routed): business event of an upstream part (event, data), by priority."""
    key = lambda k: F.col("data").rlike(f'"{k}"[ ]*:')
    name = F.col("event")
    routed = (
        F.when(name == "custom", "agent.progress")
        .when(key("__interrupt__"), "approval.required")
        .when(key("todos"), "plan.updated")
        .when(name.isin("messages", "messages/partial", "messages-tuple", "updates", "values"), "message.delta")
        .when(name.isin("error", "errors"), "run.failed")
        .otherwise("langgraph.event")
    )
    return parts.withColumn("routed", routed)


def dedup_messages(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """First row of each (thread_id, message_id); rows without an id all stay.  On a stream (which needs ``ts``) an id is remembered for ``delay``."""
    if not rows.isStreaming:
        return rows.where("message_id is null").unionByName(rows.where("message_id is not null").dropDuplicates(["thread_id", "message_id"]))
    marked = rows.withColumn("_key", F.coalesce("message_id", F.uuid()))
    return marked.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["thread_id", "_key"]).drop("_key")


def latest_state(rows: DataFrame) -> DataFrame:
    """Last snapshot of each run."""
    return rows.where("event = 'values'").groupBy("run_id").agg(F.max_by("data", "seq").alias("data"), F.max("seq").alias("seq"))


def run_lifecycle(rows: DataFrame) -> DataFrame:
    """(run_id, state, n_events, artifacts): completed or failed once such an event came, else running; artifact ids without repeats."""
    failed, done = F.count_if(F.col("event").isin("error", "errors")), F.count_if(F.col("event") == "end")
    return rows.groupBy("run_id").agg(F.when(failed > 0, "failed").when(done > 0, "completed").otherwise("running").alias("state"), F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_set("artifact_id")).alias("artifacts"))


def call_telemetry(rows: DataFrame) -> DataFrame:
    """Attempts, exhaustion, polls, last state and elapsed seconds of each call."""
    return rows.groupBy("call_id").agg(F.count_if(F.col("kind") == "retry").alias("retries"), F.bool_or("exhausted").alias("exhausted"), F.count_if(F.col("kind") == "poll").alias("polls"), F.max_by("state", "seq").alias("last_state"), (F.max("t") - F.min("t")).alias("elapsed"))


def encode_sse(rows: DataFrame) -> DataFrame:
    """``wire``: event and data as server-sent text."""
    return rows.withColumn("wire", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), "data", F.lit("\n\n")))


def event_source(rows: DataFrame) -> DataFrame:
    """Whether a namespace belongs to a subagent, and its call id (the first ``tools:`` entry)."""
    tools = F.filter("namespace", lambda x: x.startswith("tools:"))
    return rows.withColumns({"source": F.when(F.size(tools) > 0, "subagent").otherwise("main"), "call_id": F.get(tools, 0)})


def stream_corpus(spark: SparkSession, path: str, schema: str = "path string, modificationTime timestamp, length long, content binary", glob: str = "*.md") -> DataFrame:
    """Each new file of a folder once, as text; the query's checkpoint remembers what was read."""
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def unwrap_messages(rows: DataFrame) -> DataFrame:
    """(seq, message_id, tool, content): tool messages inside ``data`` (JSON), however deep.  A batch only: it walks level by level.

    A message is an object's ``kwargs`` or ``lc_kwargs``, or an object with a type, name, content or id;
    content that is not a JSON object, or the text of one, is dropped, and so is a message that names no tool.
    """
    get = lambda c, p, t="string": F.try_variant_get(c, f"$.{p}", t)
    is_object = nested.is_object
    held = nested.objects(rows.select("seq", "data"))
    kwargs, lc = get("object", "kwargs", "variant"), get("object", "lc_kwargs", "variant")
    itself = F.when(F.coalesce(*[get("object", k, "variant") for k in ("type", "name", "content", "id")]).isNotNull(), F.col("object"))
    found = cut(held.select("seq", F.when(is_object(kwargs), kwargs).when(is_object(lc), lc).otherwise(itself).alias("m"))).where("m is not null")
    tool = F.coalesce(*[F.nullif(get("m", p), F.lit("")) for p in ("name", "tool_name", "additional_kwargs.name", "additional_kwargs.tool_name")])
    content = get("m", "content", "variant")
    text = get("m", "content")  # of an object, its JSON; of a text, itself
    out = found.select("seq", get("m", "id").alias("message_id"), tool.alias("tool"), text.alias("content"), is_object(content).alias("_o"), F.try_parse_json(text).alias("_c")).where("tool is not null and _c is not null")
    return out.where(F.col("_o") | is_object(F.col("_c"))).select("seq", "message_id", "tool", "content").distinct()


def progress_rows(counts: DataFrame, stage: str) -> DataFrame:
    """Start and end events of an extraction stage, with its counts as extras; ``counts`` has trace_id, started, ended and one column a count."""
    extras = [c for c in counts.columns if c not in ("trace_id", "started", "ended")]
    made = F.create_map(*[x for c in extras for x in (F.lit(c), F.col(c).cast("string"))]) if extras else F.create_map().cast("map<string,string>")
    ends = F.array(F.struct(F.lit(f"meta.{stage}.start").alias("type"), F.col("started").alias("created_at"), F.create_map().cast("map<string,string>").alias("extras")), F.struct(F.lit(f"meta.{stage}.end").alias("type"), F.col("ended").alias("created_at"), made.alias("extras")))
    return counts.select("trace_id", F.lit("metadata").alias("component"), F.explode(ends).alias("e")).select("trace_id", "component", "e.*")


def tool_events(results: DataFrame, spec: DataFrame) -> DataFrame:
    """(id, ord, event, virtual_path): for each finished tool (id, tool, result) an ``artifact.created`` for every artifact its result names, then ``tool.completed``."""
    made = artifacts_of(results, spec).withColumn("ord", F.row_number().over(Window.partitionBy("id").orderBy("type", "virtual_path")) - 1)
    ends = results.select("id").join(made.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n")), "id", "left")
    ends = ends.select("id", F.coalesce("n", F.lit(0)).alias("ord"), F.lit("tool.completed").alias("event"), F.lit(None).cast("string").alias("virtual_path"))
    return made.select("id", "ord", F.lit("artifact.created").alias("event"), "virtual_path").unionByName(ends)
