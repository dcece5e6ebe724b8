"""Queries on evaluation: ranks, recall, percentiles, reports, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import fixed, stats
from evidara.operators import evaluate, telemetry
from evidara.plans.registry import query, table

# Results of each label's vectors: a query is a vector whose id is divisible by 50; a hit has its label.
_RESULTS = """SELECT q.vec_id AS case_id, q.label AS want, v.label AS got, v.vec_id AS hit,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidara.operators.retrieve import dense_candidates

    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = dense_candidates(asked, e.select(F.col("vec_id").alias("hit"), "embedding"), 101, "hit").where("query_id <> hit")
    labels = e.select("vec_id", "label")
    j = found.join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "want"}), "query_id").join(labels.withColumnsRenamed({"vec_id": "hit", "label": "got"}), "hit")
    # the query itself stands first among its own results, so ranks move up by one
    return j.select(F.col("query_id").alias("case_id"), "want", "got", "hit", (F.col("rank") - 1).alias("rank"))


_RANKS = f"SELECT case_id, case_id % 7 = 0 AS must_abstain, CASE WHEN case_id % 7 = 0 THEN NULL ELSE min(CASE WHEN want = got THEN rank END) END AS rank FROM ({_RESULTS}) WHERE rank <= 100 GROUP BY case_id"


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    cases = r.select("case_id").distinct().withColumn("must_abstain", F.col("case_id") % 7 == 0)
    relevant = r.where("want = got").select("case_id", "hit").distinct()
    return evaluate.relevant_ranks(cases, r, relevant, "hit")


_RECALLS = ", ".join(f"round(count(*) FILTER (rank <= {k}) / greatest(1, count(*)), 6) AS recall_at_{k}" for k in fixed.RECALL_CUTOFFS)


@query(f"SELECT must_abstain, count(*)::BIGINT AS cases, {_RECALLS} FROM ({_RANKS}) GROUP BY GROUPING SETS ((), (must_abstain))")
def grouping_sets_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evaluate.retrieval_report(ranks(spark, sf_dir))
    return df.select("must_abstain", "cases", *(F.round(f"recall_at_{k}", 6).alias(f"recall_at_{k}") for k in fixed.RECALL_CUTOFFS))


_GAINS = "SELECT case_id, want = got AS rel, rank FROM ({}) WHERE rank <= 20".format(_RESULTS)


@query(f"""
WITH g AS ({_GAINS}), d AS (SELECT case_id, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (rel) AS n, min(CASE WHEN rel THEN rank END) AS first FROM g GROUP BY case_id),
i AS (SELECT n, list_sum(list_transform(range(1, n + 1), lambda k: 1 / log2(k + 1))) AS ideal FROM (SELECT DISTINCT n FROM d) WHERE n > 0)
SELECT count(*)::BIGINT AS cases, round(sum(coalesce(1 / first, 0)) / greatest(1, count(*)), 6) AS mrr, round(count(*) FILTER (first <= 20) / greatest(1, count(*)), 6) AS recall_at_20,
  round(avg(CASE WHEN d.n = 0 THEN 1 ELSE dcg / ideal END), 6) AS ndcg_at_20 FROM d LEFT JOIN i ON d.n = i.n""")
def recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir).where("rank <= 20").select("case_id", "rank", (F.col("want") == F.col("got")).cast("int").alias("rel"))
    lists = r.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "rel"))), lambda x: x["rel"]).alias("rels"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    return lists.agg(F.count(F.lit(1)).alias("cases"), F.round(stats.mean_reciprocal_rank(F.col("first")), 6).alias("mrr"), F.round(stats.recall_at(F.col("first"), 20), 6).alias("recall_at_20"), F.round(F.avg(stats.ndcg(F.col("rels"), 20)), 6).alias("ndcg_at_20"))


@query("SELECT round(count(*) FILTER (l_linenumber <= 4 AND l_quantity <= 20) / greatest(1, count(*) FILTER (l_linenumber <= 4)), 6) AS retention, count(*)::BIGINT AS cases FROM lineitem")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines within the first cut, the share within the second: ranks are line numbers and quantities."""
    li = table(spark, sf_dir, "lineitem")
    return li.agg(F.round(stats.retention(F.col("l_linenumber"), F.col("l_quantity"), 4, 20), 6).alias("retention"), F.count(F.lit(1)).alias("cases"))


@query("""
WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (i = least(n - 1, round_even((n - 1) * 0.5, 0)::BIGINT)) AS p50, max(value) FILTER (i = least(n - 1, round_even((n - 1) * 0.95, 0)::BIGINT)) AS p95,
  max(value) FILTER (i = least(n - 1, floor(n * 0.95)::BIGINT)) AS p95_floor, max(value) FILTER (i = n // 2) AS upper_median FROM o GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = {"p50": stats.nearest_rank(0.5), "p95": stats.nearest_rank(0.95), "p95_floor": stats.floor_rank(0.95), "upper_median": stats.upper_median()}
    return stats.order_statistics(table(spark, sf_dir, "events"), "value", ["event_type"], picks)


_COST = "SELECT event_type, count(*)::BIGINT AS calls, round(avg(value), 6) AS mean_value, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY event_type"


@query("SELECT metric, round(b, 6) AS baseline, round(c, 6) AS candidate, round(c - b, 6) AS delta FROM (SELECT unnest([{'metric': 'mean', 'b': avg(value) FILTER (user_id % 2 = 0), 'c': avg(value) FILTER (user_id % 2 = 1)}, {'metric': 'n', 'b': count(*) FILTER (user_id % 2 = 0), 'c': count(*) FILTER (user_id % 2 = 1)}], recursive := true) FROM events)")
def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    half = lambda k: e.where(F.col("user_id") % 2 == k).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    d = evaluate.metric_deltas(half(0), half(1), ["mean", "n"])
    return d.select("metric", *(F.round(c, 6).alias(c) for c in ("baseline", "candidate", "delta")))


_PILOT = "SELECT doc_id, doc_id % 3 = 0 AS must_abstain, doc_id % 4 = 0 AS abstained, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE quality END AS n_claims, 1 + doc_id % 5 AS usefulness, CASE WHEN doc_id < 0 THEN NULL ELSE 0.01::DOUBLE * (doc_id % 10) END AS cost FROM labels"


def _pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "labels").select("doc_id", (i % 3 == 0).alias("must_abstain"), (i % 4 == 0).alias("abstained"), F.when(i % 4 == 0, 0).otherwise(F.col("quality")).alias("n_claims"), (1 + i % 5).alias("usefulness"), (0.01 * (i % 10)).alias("cost"))


@query(f"""
WITH c AS (SELECT *, NOT abstained AND n_claims > 0 AS said FROM ({_PILOT})), a AS (SELECT count(*) AS n, count(*) FILTER (must_abstain) AS un, count(*) FILTER (must_abstain AND said) AS fa, count(*) FILTER (NOT must_abstain AND NOT said) AS fs,
  avg(usefulness) AS u, sum(cost) AS cost, count(*) FILTER (cost IS NULL) AS unknown FROM c)
SELECT n::BIGINT AS cases_evaluated, (n - un)::BIGINT AS answerable_cases, un::BIGINT AS unanswerable_cases, round(u, 2) AS usefulness, round(fa / un, 4) AS false_answer_rate, round(fs / (n - un), 4) AS false_abstention_rate,
  round((un - fa) / un, 4) AS unanswerable_abstention_accuracy, CASE WHEN unknown = 0 THEN round(cost / n, 6) END AS mean_cost_per_query FROM a""")
def pilot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.pilot_report(_pilot(spark, sf_dir))


_STAGING = "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN {'useful': quality = 1, 'assessment': CASE WHEN toxic = 1 THEN 'unnecessarily-conservative' WHEN doc_id % 2 = 0 THEN 'correct' ELSE 'not-applicable' END} END AS fb FROM labels"


@query(f"""SELECT count(*)::BIGINT AS total_queries, count(fb)::BIGINT AS feedback_received, round(count(*) FILTER (fb.useful) / greatest(1, count(fb)), 4) AS satisfaction_rate,
  count(*) FILTER (fb.assessment = 'unnecessarily-conservative')::BIGINT AS conservative_abstentions, count(*) FILTER (fb.assessment = 'correct')::BIGINT AS correct_abstentions FROM ({_STAGING})""")
def staging_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "unnecessarily-conservative").when(F.col("doc_id") % 2 == 0, "correct").otherwise("not-applicable")
    fb = F.when(F.col("doc_id") % 3 != 0, F.struct((F.col("quality") == 1).alias("useful"), kind.alias("abstention_assessment")))
    return evaluate.staging_report(table(spark, sf_dir, "labels").select("doc_id", F.lit("answered").alias("final_decision"), fb.alias("user_feedback")))


@query("SELECT role AS decision, count(*)::BIGINT AS n FROM conversations GROUP BY role")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("decision")).agg(F.count(F.lit(1)).alias("n"))


_CASES = "SELECT conv_id, conv_id % 5 = 0 AS must_abstain, count(*) < 3 AS abstained, count(*) % 4 = 0 AS repaired, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id"


@query(f"""
WITH c AS (SELECT *, CASE WHEN abstained THEN [] ELSE turns END AS claims FROM ({_CASES})), s AS (SELECT *, NOT abstained AND len(claims) > 0 AS said, len(list_filter(claims, lambda t: t < 3)) AS held, len(list_filter(turns, lambda t: t < 3)) AS cits, len(list_filter(turns, lambda t: t < 3 AND t > 0)) AS good FROM c)
SELECT count(*)::BIGINT AS cases_evaluated, round(sum(good) / greatest(1, sum(cits)), 4) AS citation_resolvability_rate, round(sum(held) / greatest(1, sum(len(claims))), 4) AS claim_citation_membership_rate,
  round((sum(len(claims)) - sum(held)) / greatest(1, sum(len(claims))), 4) AS uncited_claim_rate, round(count(*) FILTER (CASE WHEN must_abstain THEN NOT said ELSE said END) / greatest(1, count(*)), 4) AS abstention_correctness,
  round(count(*) FILTER (repaired) / greatest(1, count(*)), 4) AS repair_rate FROM s""")
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are claims that cite themselves; only the first three turns are supplied as citations."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    ids = lambda t: t.cast("string")
    claims = F.transform("turns", lambda t: F.struct(F.array(ids(t)).alias("evidence_ids")))
    cits = F.transform(F.filter("turns", lambda t: t < 3), lambda t: F.struct(ids(t).alias("evidence_id"), F.when(t > 0, "https://example.org/").alias("official_url"), F.lit("d").alias("document_id"), F.lit("v").alias("version_id")))
    n = F.size("turns")
    cases = c.select((F.col("conv_id") % 5 == 0).alias("must_abstain"), (n < 3).alias("abstained"), (n % 4 == 0).alias("repaired"), F.when(n < 3, F.slice(claims, 1, 0)).otherwise(claims).alias("claims"), cits.alias("citations"))
    return evaluate.generation_report(cases)


@query("""
WITH e AS (SELECT l_orderkey AS case_id, l_suppkey AS claim_id, l_quantity > 2 AS entailed, l_discount < 0.09 AS authority, l_tax < 0.08 AS version, l_returnflag <> 'R' AS located FROM lineitem),
p AS (SELECT case_id, claim_id, bool_and(entailed) AS en, bool_and(authority) AS au, bool_and(version) AS ve, bool_and(located) AS lo FROM e GROUP BY ALL)
SELECT case_id, count(*)::BIGINT AS claims, round(avg(au::INT), 6) AS authority_correctness, round(avg(ve::INT), 6) AS version_correctness, round(avg(lo::INT), 6) AS locator_correctness, round(1 - round(avg((en AND au AND ve AND lo)::INT), 6), 6) AS unsupported_rate FROM p GROUP BY case_id""")
def reviewed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("claim_id"), (F.col("l_quantity") > 2).alias("entailed"), (F.col("l_discount") < 0.09).alias("authority"), (F.col("l_tax") < 0.08).alias("version"), (F.col("l_returnflag") != "R").alias("located"))
    return evaluate.reviewed_claims(li).withColumn("unsupported_rate", F.round("unsupported_rate", 6))


@query("SELECT label, count(*)::BIGINT AS n, round(min(s), 5) AS min_norm, round(max(s), 5) AS max_norm, round(avg(s), 5) AS mean_norm FROM (SELECT label, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS s FROM embeddings) GROUP BY label")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    e = table(spark, sf_dir, "embeddings").select("label", norm.alias("s"))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("s"), 5).alias("min_norm"), F.round(F.max("s"), 5).alias("max_norm"), F.round(F.avg("s"), 5).alias("mean_norm"))


@query("SELECT event_type AS model, count(*)::BIGINT AS calls, round(sum(CASE event_type WHEN 'view' THEN round(user_id / 1000000 * 0.35 + 10 / 1000000 * 2.0, 8) WHEN 'click' THEN round(user_id / 1000000 * 1.5, 8) END), 6) AS cost FROM events GROUP BY event_type")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame([("view", 0.35, 2.0), ("click", 1.5, 0.0)], "model string, input_rate double, output_rate double")
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("input_tokens"), F.lit(10).alias("output_tokens"))
    return telemetry.model_cost(rates, calls).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))


# Spans: an order is a trace, its first line the root, every other line a child of the line before.
@query("SELECT l_orderkey AS trace, l_linenumber AS line, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1)::INTEGER AS depth FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = max(l_linenumber) AND count(DISTINCT l_linenumber) = count(*))")
def span_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trace"), F.col("l_linenumber").alias("line"))
    whole = li.groupBy("trace").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("m"), F.count_distinct("line").alias("u")).where("n = m and n = u").select("trace")
    spans = li.join(whole, "trace", "left_semi").select(F.col("trace").alias("trace_id"), F.col("line").alias("span_id"), F.when(F.col("line") > 1, (F.col("line") - 1).cast("string")).alias("parent_span_id"), F.col("line").cast("string").alias("name"))
    spans = spans.withColumn("span_id", F.col("span_id").cast("string"))
    return telemetry.depths(spans).select(F.col("trace_id").alias("trace"), F.col("span_id").cast("int").alias("line"), "depth")


@query("""
WITH m AS (SELECT event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY event_type), a AS (SELECT round(avg(value), 6) AS threshold FROM events)
SELECT metric, value, threshold FROM m, a WHERE NOT CASE WHEN metric < 'm' THEN value >= threshold ELSE value <= threshold END""")
def exit_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events whose mean misses that of all events, from below or, in the second half of the alphabet, from above."""
    e = table(spark, sf_dir, "events")
    m = e.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    t = e.agg(F.round(F.avg("value"), 6).alias("threshold"))
    ok = F.when(F.col("metric") < "m", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return m.join(F.broadcast(t), F.lit(True)).where(~ok).select("metric", "value", "threshold")  # one row
