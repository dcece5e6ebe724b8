"""Telemetry: span trees flattened, costs, payload encoding."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import fixed
from evidara.operators.lineage import checkpointed

SAFE_ATTRIBUTES = ["settings_version", "version", "error.type", "evaluation.kind"]


def model_cost(rates: DataFrame, calls: DataFrame) -> DataFrame:
    """calls (model, input_tokens, output_tokens) with cost: per-million rates, null for unknown models, 8 places."""
    per = lambda tokens, r: F.greatest(F.lit(0), F.col(tokens)) / 1_000_000 * F.col(r)
    j = calls.join(rates, "model", "left")
    return j.withColumn("cost", F.when(F.col("input_rate").isNotNull(), F.round(per("input_tokens", "input_rate") + per("output_tokens", "output_rate"), 8))).drop("input_rate", "output_rate")


def with_model_spans(spans: DataFrame, observations: DataFrame) -> DataFrame:
    """Spans with a child span for each model observation: it ends with its parent's end and starts at most its latency before, not before the parent."""
    own = observations.join(spans.select("span_id", "trace_id", F.col("start_ns").alias("p_start"), F.col("end_ns").alias("p_end")), "span_id")
    start = F.greatest(F.col("p_start"), F.col("p_end") - (F.col("latency_ms") * 1_000_000).cast("bigint"))
    child = own.select(F.substring(F.sha2("observation_id", 256), 1, 16).alias("span_id"), F.col("span_id").alias("parent_span_id"), "trace_id", F.concat(F.lit("model."), "model").alias("name"), start.alias("start_ns"), F.col("p_end").alias("end_ns"))
    return spans.select("span_id", "parent_span_id", "trace_id", "name", "start_ns", "end_ns").unionByName(child)


def depths(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth, path): level by level from the roots, a join for each level that has spans, each level written before the next."""
    spans = checkpointed(spans.select("trace_id", "span_id", "parent_span_id", "name"))
    level = spans.where("parent_span_id is null or parent_span_id = ''").select("trace_id", "span_id", F.lit(0).alias("depth"), F.col("name").alias("path"))
    found = level
    for k in count(1):
        up = level.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("path").alias("up"))
        level = checkpointed(spans.join(up, ["trace_id", "parent_span_id"]).select("trace_id", "span_id", F.lit(k).alias("depth"), F.concat_ws("/", "up", "name").alias("path")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


def safe_attributes(attributes: Column) -> Column:
    """The allow-listed attributes of a string map, encoded as key and string value."""
    kept = F.map_filter(attributes, lambda k, _: k.isin(SAFE_ATTRIBUTES))
    return F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))


def encoded(spans: DataFrame) -> DataFrame:
    """(trace_id, payload): the spans of a trace as one JSON payload; traces without a valid id drop out."""
    ok = F.col("trace_id").rlike("^[0-9a-f]{32}$") & (F.col("trace_id") != "0" * 32)
    said = F.col("attributes") if "attributes" in spans.columns else F.lit(None).cast("map<string,string>")
    one = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.coalesce("parent_span_id", F.lit("")).alias("parentSpanId"), "name", F.lit(1).alias("kind"),
        F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.coalesce("end_ns", "start_ns").cast("string").alias("endTimeUnixNano"),
        F.coalesce(safe_attributes(said), F.array().cast("array<struct<key:string,value:struct<stringValue:string>>>")).alias("attributes"),
    )
    return spans.where(ok).groupBy("trace_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("spans"))).alias("payload"))


def trace_attributes(records: DataFrame) -> DataFrame:
    """(query_id, attributes) of staging records, pending and not-applicable where nothing was said."""
    said = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    pairs = {
        "trial.query_id": said("query_id", ""), "decision.final": said("final_decision", ""), "decision.corpus_scope_reason": said("corpus_scope_reason", "not-applicable"),
        "decision.evidence_adequacy_reason": said("evidence_adequacy_reason", "not-applicable"), "feedback.useful": said("user_feedback.useful", "pending"),
        "feedback.abstention_assessment": said("user_feedback.abstention_assessment", "pending"), "feedback.correction": F.when(F.col("user_feedback").isNull(), "pending").otherwise(F.coalesce("user_feedback.user_correction", F.lit(""))),
    }
    return records.select("query_id", F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))).alias("attributes"))

