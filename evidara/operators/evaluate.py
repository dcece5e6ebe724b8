"""Evaluation: containment joins, ranks of the relevant, reports over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidara.functions import fixed
from evidara.functions.stats import recall_at
from evidara.operators.lineage import checkpointed


def containing(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """Chunks that hold a passage: equal document, version and section, and the chunk's span around the passage's; by table id where there is no span."""
    keys = ["document_id", "version_id", "section_id"]
    p = passages.withColumnsRenamed({"char_start": "p_start", "char_end": "p_end", "table_id": "p_table"})
    span = F.col("char_start").isNotNull() & F.col("char_end").isNotNull()
    holds = F.when(span, (F.col("char_start") <= F.col("p_start")) & (F.col("char_end") >= F.col("p_end"))).otherwise(F.col("table_id") == F.col("p_table"))
    return chunks.join(p, keys).where(holds)


def relevant_ranks(cases: DataFrame, results: DataFrame, relevant: DataFrame, key: str) -> DataFrame:
    """(case_id, must_abstain, rank): the best rank of a relevant result; a case that must abstain ranks 1 if nothing came back, else null."""
    hits = results.join(relevant, ["case_id", key], "left_semi").groupBy("case_id").agg(F.min("rank").alias("hit"))
    back = results.select("case_id").distinct().withColumn("answered", F.lit(True))
    j = cases.join(hits, "case_id", "left").join(back, "case_id", "left")
    return j.select("case_id", "must_abstain", F.when(F.col("must_abstain"), F.when(F.col("answered").isNull(), 1)).otherwise(F.col("hit")).alias("rank"))


def retrieval_report(ranks: DataFrame) -> DataFrame:
    """(must_abstain or null for all, cases, recall_at_*) by grouping sets."""
    return ranks.groupingSets([[], [F.col("must_abstain")]], F.col("must_abstain")).agg(F.count(F.lit(1)).alias("cases"), *(recall_at(F.col("rank"), k).alias(f"recall_at_{k}") for k in fixed.RECALL_CUTOFFS))


def as_of(facts: DataFrame, validity: DataFrame, on: list[str], when: str, half_open: bool = False) -> DataFrame:
    """Facts with the rows of validity in force at their date: closed intervals, or half-open ones; a null bound is open."""
    after = F.col("valid_from").isNull() | (F.col("valid_from") <= F.col(when))
    end = F.col(when) < F.col("valid_to") if half_open else F.col(when) <= F.col("valid_to")
    return facts.join(validity, on).where(after & (F.col("valid_to").isNull() | end))


def sub_map(expected: Column, actual: Column) -> Column:
    """Every expected key has its value in the actual map."""
    return F.forall(F.map_entries(expected), lambda e: F.element_at(actual, e["key"]).eqNullSafe(e["value"]))


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys on one side only; empty when the sides have the same keys."""
    a, b = left.select(F.col(key).alias("l")).distinct(), right.select(F.col(key).alias("r")).distinct()
    j = a.join(b, F.col("l") == F.col("r"), "full_outer").where("l is null or r is null")
    return j.select(F.coalesce("l", "r").alias(key), F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def metric_deltas(before: DataFrame, after: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, baseline, candidate, delta) of two one-row reports."""
    long = lambda df, name: df.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics))).alias("m")).select("m.*")
    return long(before, "baseline").join(long(after, "candidate"), "metric").withColumn("delta", F.col("candidate") - F.col("baseline"))


def rate(part: Column, whole: Column, places: int = 4) -> Column:
    return F.round(part / F.greatest(F.lit(1), whole), places)


def generation_report(cases: DataFrame) -> DataFrame:
    """One row over cases (must_abstain, abstained, repaired, claims, citations): abstention, citation and repair rates.

    claims: array<struct<evidence_ids>>, citations: array<struct<evidence_id, official_url, document_id, version_id>>.
    """
    said = ~F.col("abstained") & (F.size("claims") > 0)
    ids = F.transform("citations", lambda c: c["evidence_id"])
    held = F.size(F.filter("claims", lambda c: (F.size(c["evidence_ids"]) > 0) & (F.size(F.array_except(c["evidence_ids"], ids)) == 0)))
    resolvable = F.size(F.filter("citations", lambda c: (F.coalesce(c["official_url"], F.lit("")) != "") & (F.coalesce(c["document_id"], F.lit("")) != "") & (F.coalesce(c["version_id"], F.lit("")) != "")))
    n, claims, cits = F.count(F.lit(1)), F.sum(F.size("claims")), F.sum(F.size("citations"))
    return cases.agg(
        n.alias("cases_evaluated"),
        rate(F.sum(resolvable), cits).alias("citation_resolvability_rate"),
        rate(F.sum(held), claims).alias("claim_citation_membership_rate"),
        rate(claims - F.sum(held), claims).alias("uncited_claim_rate"),
        rate(F.count_if(F.when(F.col("must_abstain"), ~said).otherwise(said)), n).alias("abstention_correctness"),
        rate(F.count_if("repaired"), n).alias("repair_rate"),
    )


def pilot_report(cases: DataFrame) -> DataFrame:
    """One row over cases (must_abstain, abstained, n_claims, usefulness, cost): error rates and costs; the cost is null if any is unknown."""
    said = ~F.col("abstained") & (F.col("n_claims") > 0)
    n, un = F.count(F.lit(1)), F.count_if("must_abstain")
    ans = n - un
    wrong_answers, wrong_silence = F.count_if(F.col("must_abstain") & said), F.count_if(~F.col("must_abstain") & ~said)
    share = lambda a, b, none: F.when(b > 0, F.round(a / F.greatest(F.lit(1), b), 4)).otherwise(none)
    return cases.agg(
        n.alias("cases_evaluated"), ans.alias("answerable_cases"), un.alias("unanswerable_cases"), F.round(F.avg("usefulness"), 2).alias("usefulness"),
        share(wrong_answers, un, 0.0).alias("false_answer_rate"), share(wrong_silence, ans, 0.0).alias("false_abstention_rate"), share(un - wrong_answers, un, 1.0).alias("unanswerable_abstention_accuracy"),
        F.when(F.count_if(F.col("cost").isNull()) == 0, F.round(F.sum("cost") / F.greatest(F.lit(1), n), 6)).alias("mean_cost_per_query"),
    )


def staging_report(records: DataFrame) -> DataFrame:
    """One row over records (final_decision, feedback struct or null)."""
    fb = F.col("user_feedback")
    n = F.count_if(fb.isNotNull())
    return records.agg(
        F.count(F.lit(1)).alias("total_queries"), n.alias("feedback_received"),
        F.when(n > 0, F.round(F.count_if(fb["useful"]) / F.greatest(F.lit(1), n), 4)).alias("satisfaction_rate"),
        F.count_if(fb["abstention_assessment"] == "unnecessarily-conservative").alias("conservative_abstentions"),
        F.count_if(fb["abstention_assessment"] == "correct").alias("correct_abstentions"),
    )


def reviewed_claims(claims: DataFrame) -> DataFrame:
    """Per case (case_id, claim_id, entailed, authority, version, located - one row per cited evidence): all-of per claim, then rates."""
    ok = lambda c: F.bool_and(F.coalesce(F.col(c), F.lit(False)))
    per = claims.groupBy("case_id", "claim_id").agg(ok("entailed").alias("entailed"), ok("authority").alias("authority"), ok("version").alias("version"), ok("located").alias("located"))
    per = per.withColumn("supported", F.col("entailed") & F.col("authority") & F.col("version") & F.col("located"))
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return per.groupBy("case_id").agg(F.count(F.lit(1)).alias("claims"), mean("authority").alias("authority_correctness"), mean("version").alias("version_correctness"), mean("located").alias("locator_correctness"), (1 - mean("supported")).alias("unsupported_rate"))


def quota_sample(rows: DataFrame, group: str, order: list[Column], unique: list[str], quotas: dict[str, int]) -> DataFrame:
    """Rows taken group by group, in the order of the quotas, until each quota is full: (*, taken).

    A row is passed over if a row that was taken before it, in this group or an earlier one, has one of its unique
    keys; rows that were not taken block none. Raises if a group falls short.
    """
    from evidara.operators.retrieve import top

    found, taken_keys = None, {u: None for u in unique}
    for name, quota in quotas.items():
        left, mine = rows.where(F.col(group) == name), None
        for u, keys in taken_keys.items():
            left = left if keys is None else left.join(keys, u, "left_anti")
        while True:  # rows that are the first for all of their keys are taken, what shares a key with them is not
            firsts = left
            for k, u in enumerate(unique):
                firsts = firsts.withColumn(f"_first{k}", F.row_number().over(Window.partitionBy(u).orderBy(*order)))
            sure = firsts.where(" and ".join(f"_first{k} = 1" for k in range(len(unique))) or "true").drop(*(f"_first{k}" for k in range(len(unique))))
            mine = sure if mine is None else mine.unionByName(sure)
            if len(unique) < 2:
                break
            mine = checkpointed(mine)
            for u in unique:
                left = left.join(mine.select(u).distinct(), u, "left_anti")
            left = checkpointed(left)
            if left.isEmpty():
                break
        mine = checkpointed(top(mine.withColumn("_all", F.lit(1)), ["_all"], order, quota, "taken").drop("_all"))
        if (n := mine.count()) < quota:
            raise ValueError(f"{name}: {n} rows for a quota of {quota}")
        for u in unique:
            own = mine.select(u).distinct()
            taken_keys[u] = own if taken_keys[u] is None else taken_keys[u].unionByName(own)
        found = mine if found is None else found.unionByName(mine)
    return found


def set_faults(name: str, df: DataFrame, needed: list[str], column: str) -> DataFrame:
    """(fixture, missing, unknown): what a coverage lacks and has beyond the required set."""
    want = F.array(*(F.lit(x) for x in needed))
    have = F.collect_set(column)
    return df.agg(have.alias("h")).select(F.lit(name).alias("fixture"), F.sort_array(F.array_except(want, "h")).alias("missing"), F.sort_array(F.array_except("h", want)).alias("unknown"))


def reranker_report(cases: DataFrame, cuts: tuple[int, int] = (80, 20)) -> DataFrame:
    """One row over cases (before, after, relevances, latency_ms, tokens, cost): ranking quality before and after, retention, latency and totals."""
    from evidara.functions import stats

    quality = lambda c, n: [F.round(stats.mean_reciprocal_rank(F.col(c)), 4).alias(f"{n}_mrr"), F.round(recall_at(F.col(c), cuts[1]), 4).alias(f"{n}_recall")]
    sums = cases.agg(
        F.count(F.lit(1)).alias("cases"), *quality("before", "first_stage"), *quality("after", "reranked"), F.round(F.avg(stats.ndcg(F.col("relevances"), cuts[1])), 4).alias("ndcg"),
        F.round(stats.retention(F.col("before"), F.col("after"), *cuts), 4).alias("retention"), F.round(F.avg("latency_ms"), 2).alias("latency_mean"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"),
    )
    late = stats.order_statistics(cases, "latency_ms", [], {"latency_p50": stats.nearest_rank(0.5), "latency_p95": stats.nearest_rank(0.95)})
    return sums.join(F.broadcast(late), F.lit(True))  # one row each


def rank_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(query_id, key, rank_before, rank_after, wins) of results that either list has; wins: it moved up."""
    j = before.select("query_id", key, F.col("rank").alias("rank_before")).join(after.select("query_id", key, F.col("rank").alias("rank_after")), ["query_id", key], "full_outer")
    return j.withColumn("wins", F.coalesce(F.col("rank_after") < F.col("rank_before"), F.col("rank_before").isNull()))


def abstention_rates(cases: DataFrame) -> DataFrame:
    """One row over cases (must_abstain, abstained, n_units): abstention accuracy, false answers, context hits and mean context size."""
    n = F.count(F.lit(1))
    return cases.agg(
        rate(F.count_if(F.col("abstained") == F.col("must_abstain")), n).alias("abstention_accuracy"), rate(F.count_if(F.col("must_abstain") & ~F.col("abstained")), F.count_if("must_abstain")).alias("false_answer_rate"),
        rate(F.count_if(F.col("n_units") > 0), n).alias("context_hit_rate"), F.round(F.avg("n_units"), 4).alias("mean_context_units"),
    )


def metric_successes(scores: DataFrame) -> DataFrame:
    """(metric, cases, success_rate, mean_score) of scores (metric, score, threshold) that a judge gave."""
    return scores.groupBy("metric").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg((F.col("score") >= F.col("threshold")).cast("int")), 4).alias("success_rate"), F.round(F.avg("score"), 4).alias("mean_score"))


def corrected(cases: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """Cases with the columns of keyed overrides in place of their own where these are not null."""
    o = overrides.select("id", *(F.col(c).alias(f"_{c}") for c in columns))
    return cases.join(o, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))
