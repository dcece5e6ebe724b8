"""English full-text search for batches of queries: stems, stop words, web-search syntax, cover density.

A query's syntax is that of search boxes: words are all wanted, "quoted words" stand next to each other,
OR parts alternatives, a minus before a word or quotes excludes. Words joined by punctuation, such as 40-10,
count as quoted. Stop words vanish, but keep their places inside quotes. An alternative without a
wanted word finds nothing. Texts are runs of letters and digits, lower-cased, their places counted from 0.

Only words whose stems are asked for become postings, one row per chunk. Each alternative looks for its rarest stem first;
chunks that have it and all its other stems are judged by the places of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from evidara.functions import fixed
from evidara.functions.stem import with_stems
from evidara.operators.lineage import checkpointed
from evidara.operators.retrieve import top

TERM = r"[\p{L}\p{N}]+"
PART = r'-?"[^"]+"|[^\s"]+'
WEIGHT = 0.1
#: Queries that a task keeps compiled, and words with a wanted stem that are sent to the texts; more are joined.
COMPILED, SENT_WORDS = 4_096, 500_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def parsed(queries: DataFrame) -> DataFrame:
    """(query_id, alternative, part, excluded, place, word) of queries (query_id, query): every word that is not a stop word."""
    parts = F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit(PART), F.lit(0))
    rows = queries.select("query_id", F.posexplode(parts).alias("part", "said"))
    is_or = F.lower("said") == "or"
    before = Window.partitionBy("query_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("alternative", F.count_if(is_or).over(before)).where(~is_or)  # a query's parts
    rows = rows.select("query_id", "alternative", "part", F.col("said").startswith("-").alias("excluded"), F.posexplode(words(F.col("said"))).alias("place", "word"))
    return rows.where(~F.col("word").isin(fixed.SEARCH_STOP_WORDS))


def stemmed(parts: DataFrame) -> DataFrame:
    """Parsed queries with stems instead of words; the rules run once for each distinct word."""
    return parts.join(with_stems(parts.select("word").distinct()), "word").drop("word")


def plans(parts: DataFrame) -> DataFrame:
    """(query_id, parts): each query as an array of (alternative, excluded, terms: place, stem), excluded parts last."""
    one = parts.groupBy("query_id", "alternative", "part", "excluded").agg(F.sort_array(F.collect_list(F.struct("place", "stem"))).alias("terms"))
    return one.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("excluded", "alternative", "part", "terms"))).alias("parts"))


def postings(chunks: DataFrame, stems: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, places: stem -> its places in order) of chunks (key, text) that hold one of the stems."""
    token = chunks.select(key, F.posexplode(words(F.col("text"))).alias("place", "word"))
    distinct = token.select("word").distinct().repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but much to do for each
    known = checkpointed(with_stems(distinct).join(stems.distinct(), "stem"))
    if known.count() <= SENT_WORDS:
        known = F.broadcast(known)  # so that other words are not shuffled
    # dealt out by chunk once: both groupings are a chunk's own words
    lists = token.join(known, "word").repartition(key).groupBy(key, "stem").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return lists.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("stem", "places"))).alias("places"))


def compiled(parts: list[dict]) -> list[tuple[list, list]]:
    """A query's alternatives in order, each as its wanted and its excluded parts; a part is its stems with their distances from the first one."""
    out: dict[int, tuple[list, list]] = {}
    for p in parts:
        terms = [(t["stem"], t["place"] - p["terms"][0]["place"]) for t in p["terms"]]
        out.setdefault(p["alternative"], ([], []))[bool(p["excluded"])].append(terms)
    return [out[k] for k in sorted(out) if out[k][0]]


def _occurrences(terms: list[tuple[str, int]], places: dict[str, np.ndarray]) -> np.ndarray:
    """First places of a part's occurrences, in order."""
    none = np.zeros(0, np.int64)
    at = places.get(terms[0][0], none)
    for stem, far in terms[1:]:
        if not len(at):
            break
        other = places.get(stem, none)
        if not len(other):
            return none
        wanted = at + far
        at = at[other[np.minimum(np.searchsorted(other, wanted), len(other) - 1)] == wanted]
    return at


def cover(alternatives: list[tuple[list, list]], places: dict[str, np.ndarray]) -> float | None:
    """`density` of a compiled query."""
    fit = []
    for wanted, excluded in alternatives:
        own = []
        for terms in wanted:
            at = _occurrences(terms, places)
            if not len(at):
                break
            own.append((at, terms[-1][1]))
        if len(own) == len(wanted) and not any(len(_occurrences(terms, places)) for terms in excluded):
            fit.append(own)
    if not fit:
        return None
    held = np.unique(np.concatenate(list(places.values())))
    ends = np.unique(np.concatenate([at + far for wanted in fit for at, far in wanted]))
    low = np.full(len(ends), -1)  # the latest place from which a span up to each end satisfies the query
    for wanted in fit:
        start = np.full(len(ends), np.iinfo(np.int64).max)
        for at, far in wanted:
            last = np.searchsorted(at + far, ends, side="right") - 1
            start = np.minimum(start, np.where(last >= 0, at[np.maximum(last, 0)], -1))
        low = np.maximum(low, start)
    least = (low >= 0) & np.append(True, low[1:] != low[:-1])
    low, ends = low[least], ends[least]
    inside = np.searchsorted(held, ends, side="right") - np.searchsorted(held, low)
    return float((WEIGHT / (2 + ends - low - inside)).sum())


def density(parts: list[dict], places: dict[str, np.ndarray]) -> float | None:
    """A chunk's cover density for a query, None if it does not satisfy it.

    The sum over minimal covers - spans that satisfy the query and hold no smaller such span - of
    0.1 / (1 + words in the span that are not the query's).
    """
    return cover(compiled(parts), places)


def matches(queries: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score): the chunks (key, text) that satisfy a query, with their cover density."""
    parts = checkpointed(stemmed(parsed(queries)))
    held = checkpointed(postings(chunks, parts.select("stem"), key))  # read three times
    stem = held.select(key, F.explode(F.map_keys("places")).alias("stem"))
    wanted = parts.where("not excluded").join(stem.groupBy("stem").agg(F.count(F.lit(1)).alias("df")), "stem", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = wanted.groupBy("query_id", "alternative").agg(F.min(F.struct("df", "stem")).alias("r")).where("r.df > 0").select("query_id", F.col("r.stem").alias("stem")).distinct()
    pairs = stem.join(rarest, "stem").select("query_id", key).distinct()
    asked = F.array_distinct(F.flatten(F.transform("parts", lambda p: p["terms"]["stem"])))
    both = pairs.join(held, key).join(plans(parts).withColumn("asked", asked), "query_id")
    # what an alternative cannot do without is a matter of the chunk's stems; the places of the asked ones are judged after that
    some = F.array_distinct(F.transform(F.filter("parts", lambda p: ~p["excluded"]), lambda p: p["alternative"]))
    whole = F.exists(some, lambda a: F.forall("parts", lambda p: p["excluded"] | (p["alternative"] != a) | F.forall(p["terms"], lambda t: F.map_contains_key("places", t["stem"]))))
    own = both.where(whole).select("query_id", key, "parts", F.transform("asked", lambda s: F.coalesce(F.try_element_at("places", s), F.array().cast("array<int>"))).alias("places"))
    kinds = {f.name: f.dataType for f in own.schema.fields}

    def judge(batches):  # noqa: ANN001, ANN202
        known: dict = {}  # compiled queries and their stems: a query's rows share one
        for batch in batches:
            lists, scores = batch.column(3), []
            row, place, values = lists.offsets.to_numpy(), lists.values.offsets.to_numpy(), lists.values.values.to_numpy()
            for k, query in enumerate(batch.column(0).to_pylist()):
                if query not in known:
                    if len(known) >= COMPILED:
                        known.clear()
                    parts = batch.column(2)[k].as_py()
                    known[query] = compiled(parts), list(dict.fromkeys(t["stem"] for p in parts for t in p["terms"]))
                alternatives, asked = known[query]
                ends = place[row[k] : row[k + 1] + 1]
                scores.append(cover(alternatives, {s: values[a:b].astype(np.int64) for s, a, b in zip(asked, ends[:-1], ends[1:])}))
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["query_id", key, "score"])
            yield found.filter(found.column(2).is_valid())

    return own.mapInArrow(judge, StructType([StructField("query_id", kinds["query_id"]), StructField(key, kinds[key]), StructField("score", DoubleType())]))


def search(queries: DataFrame, chunks: DataFrame, k: int = fixed.LEXICAL_LIMIT, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score, rank): the k best active chunks (key, text, authority_rank, is_active) of each query (query_id, query).

    Ties go to the better authority (unranked last), then to the smaller key.
    """
    live = chunks.where("is_active")
    found = matches(queries, live.select(key, "text"), key).join(live.select(key, "authority_rank"), key)
    return top(found, ["query_id"], [F.desc(F.round("score", 9)), F.asc_nulls_last("authority_rank"), F.asc(key)], k).select("query_id", key, "score", "rank")
