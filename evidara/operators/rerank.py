"""After retrieval: duplicates out, heuristic reranking, parent expansion under a token budget.

Groups are at most CANDIDATE_LIMIT rows per query, so ordered folds over arrays are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import fixed
from evidara.functions.text import jaccard, term_set
from evidara.operators.retrieve import top


def deduplicated(candidates: DataFrame, text: str = "content", threshold: float = fixed.NEAR_DUPLICATE, limit: int = fixed.CANDIDATE_LIMIT) -> DataFrame:
    """Candidates (query_id, rank, *) without those whose terms repeat an earlier kept one's; the first wins."""
    terms = candidates.where(F.col("rank") <= limit).select("query_id", F.struct("rank", term_set(F.col(text)).alias("terms")).alias("c"))
    lists = terms.groupBy("query_id").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    kept = F.aggregate(
        "cs",
        F.expr("cast(array() as array<struct<rank:int,terms:array<string>>>)"),
        lambda acc, c: F.when(F.exists(acc, lambda k: jaccard(k["terms"], c["terms"]) >= threshold), acc).otherwise(F.concat(acc, F.array(F.struct(c["rank"].cast("int").alias("rank"), c["terms"].alias("terms"))))),
    )
    ranks = lists.select("query_id", F.explode(F.transform(kept, lambda k: k["rank"])).alias("rank"))
    return candidates.join(ranks, ["query_id", "rank"])


def signals(query: Column, content: Column, header: Column, source_class: Column) -> dict[str, Column]:
    """The four relevance signals, rounded to 4 places, and their composite."""
    asked = term_set(query)
    held = F.array_union(term_set(content), term_set(header))
    relevant = F.least(F.lit(1.0), F.size(F.array_intersect(asked, held)) / F.greatest(F.lit(1), F.size(asked)) * 1.2)
    words = F.size(F.filter(F.split(content, r"(?U)\s+"), lambda w: w != ""))
    bearing = F.least(F.lit(1.0), 0.4 + F.regexp_count(content, F.lit(fixed.LEGAL_MARKERS)) / F.greatest(F.lit(1), words) * 3.0)
    bearing = F.when(words < 15, bearing * 0.5).otherwise(bearing)
    fit = F.coalesce(*(F.when(source_class == c, w) for c, w in fixed.AUTHORITY_WEIGHTS.items()), F.lit(fixed.OTHER_AUTHORITY))
    time = F.when(content.contains("1997") | content.contains("202"), 0.95).otherwise(0.85)
    out = {"relevant": F.round(relevant, 4), "answer_bearing": F.round(bearing, 4), "authority_fit": F.round(fit, 4), "temporal_fit": F.round(time, 4)}
    total = sum((w * c for w, c in zip(fixed.COMPOSITE, out.values())), F.lit(0.0))
    return out | {"composite": F.round(total, 6)}


def reranked(candidates: DataFrame, n: int = fixed.CHILD_LIMIT) -> DataFrame:
    """Candidates (query_id, query, rank, content, contextual_header, source_class) by composite; ties keep their rank."""
    scored = candidates.withColumns(signals(F.col("query"), F.col("content"), F.col("contextual_header"), F.col("source_class")))
    return top(scored, ["query_id"], [F.desc("composite"), F.asc("rank")], n, "reranked")


def budgeted(children: DataFrame, parents: DataFrame, budget: int = fixed.TOKEN_BUDGET, most: int = fixed.MAX_EVIDENCE) -> DataFrame:
    """(query_id, ordinal, evidence_id, parent_id, text_units, used_units): parents of children (query_id, reranked, parent_id) in order.

    Each parent once; one that does not fit is skipped, not the end; the first always fits; `most` at the end.
    """
    first = children.groupBy("query_id", "parent_id").agg(F.min("reranked").alias("at"))
    units = first.join(parents.select("parent_id", "text_units"), "parent_id").select("query_id", F.struct("at", "parent_id", "text_units").alias("p"))
    lists = units.groupBy("query_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    start = F.expr("named_struct('total', 0L, 'kept', cast(array() as array<struct<parent_id:string,text_units:bigint,total:bigint>>))")

    def step(acc: Column, p: Column) -> Column:
        n = p["text_units"].cast("bigint")
        takes = (F.size(acc["kept"]) < most) & ((F.size(acc["kept"]) == 0) | (acc["total"] + n <= budget))
        kept = F.concat(acc["kept"], F.array(F.struct(p["parent_id"].cast("string").alias("parent_id"), n.alias("text_units"), (acc["total"] + n).alias("total"))))
        return F.when(takes, F.struct((acc["total"] + n).alias("total"), kept.alias("kept"))).otherwise(acc)

    kept = lists.select("query_id", F.posexplode(F.aggregate("ps", start, step)["kept"]).alias("k", "e"))
    return kept.select("query_id", (F.col("k") + 1).alias("ordinal"), F.concat(F.lit("E"), F.col("k") + 1).alias("evidence_id"), "e.parent_id", "e.text_units", F.col("e.total").alias("used_units"))
