"""Queries on retrieval: the three channels, their fusion, reranking, context and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import fixed
from evidara.functions import text as T
from evidara.operators import answer, fulltext, index, rerank, retrieve, vector_index
from evidara.operators.lineage import scratch_folder
from evidara.plans.fulltext_sql import matches_sql, search_sql
from evidara.plans.registry import query, quoted, table
from evidara.plans.text import LETTERS, identifiers_sql, terms_sql

# Chunks of the test tables: a document is a chunk of its source; every seventh one is inactive.
_CHUNKS = "SELECT doc_id AS chunk_id, 'doc' || doc_id AS document_id, '[DOCUMENT: ' || lang || ' ' || source || ']' AS contextual_header, source AS canonical_reference_id, source || '#' || lang AS section_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 4)::INTEGER END AS authority_rank, doc_id % 7 <> 0 AS is_active, text FROM documents"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.concat(F.lit("doc"), "doc_id").alias("document_id"), F.concat(F.lit("[DOCUMENT: "), "lang", F.lit(" "), "source", F.lit("]")).alias("contextual_header"),
        F.col("source").alias("canonical_reference_id"), F.concat("source", F.lit("#"), "lang").alias("section_id"), F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") % 4).cast("int")).alias("authority_rank"), (F.col("doc_id") % 7 != 0).alias("is_active"), "text",
    )


_NORMAL = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_INDEX = "\nUNION\n".join(
    f"SELECT {_NORMAL.format(expr)} AS normalized_identifier, '{kind}' AS identifier_type, chunk_id FROM ({_CHUNKS}) WHERE is_active AND nullif({expr}, '') IS NOT NULL"
    for kind, expr in (("document_id", "document_id"), ("document_title", r"regexp_extract(contextual_header, '\[DOCUMENT: ([^\]]+)\]', 1)"), ("citation", "canonical_reference_id"), ("section", "section_id"), ("section", "split_part(section_id, '#', 2)"))
)


@query(_INDEX)
def truncate_insert_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identifier index of all active chunks."""
    return index.identifier_rows(chunks(spark, sf_dir))


_WANTED = "SELECT item_id AS query_id, unnest(['src' || item_id % 20, 'doc' || item_id * 3, 'en', 'ensrc' || item_id % 20]) AS normalized_identifier FROM benchmark"


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = (F.col("item_id") % 20).cast("string")
    ids = F.array(F.concat(F.lit("src"), i), F.concat(F.lit("doc"), (F.col("item_id") * 3).cast("string")), F.lit("en"), F.concat(F.lit("ensrc"), i))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(ids).alias("normalized_identifier"))


_EXACT = f"""
WITH c AS ({_CHUNKS}), i AS ({_INDEX}), w AS ({_WANTED}),
s AS (SELECT query_id, i.chunk_id, 10 * max(CASE identifier_type WHEN 'citation' THEN 4 WHEN 'section' THEN 3 WHEN 'document_title' THEN 2 ELSE 1 END) + count(*) AS score
  FROM i JOIN w USING (normalized_identifier) GROUP BY ALL),
r AS (SELECT query_id, s.chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, authority_rank ASC NULLS LAST, s.chunk_id) AS rank FROM s JOIN c ON c.chunk_id = s.chunk_id AND is_active)
SELECT query_id, chunk_id, score::BIGINT AS score, rank::INTEGER AS rank FROM r WHERE rank <= {fixed.EXACT_LIMIT}"""


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return retrieve.exact_candidates(wanted(spark, sf_dir), index.identifier_rows(c), c)


@query(_EXACT)
def exact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact(spark, sf_dir)


_ITEMS = "SELECT item_id AS query_id, text AS query FROM benchmark"
_WANTED_WORDS = f"SELECT query_id, terms AS query FROM ({terms_sql(_ITEMS)})"
_LEXICAL = f"SELECT query_id, chunk_id, round(score, 9) AS score, rank::INTEGER AS rank FROM ({search_sql(_WANTED_WORDS, _CHUNKS)})"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole items as queries, without generic words and identifiers."""
    found = fulltext.search(items(spark, sf_dir).withColumn("query", T.lexical_terms(F.col("query"))), chunks(spark, sf_dir))
    return found.withColumn("score", F.round("score", 9))


@query(_LEXICAL)
def lexical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir)


# Box queries of an item: its first two words in quotes, or its third and fourth word without the fifth, or its last two words and the first.
_WORDS = "regexp_extract_all(text, '[\\p{L}\\p{N}]+')"
_BOX = f"""SELECT item_id AS query_id, '"' || w[1] || ' ' || w[2] || '" or ' || w[3] || ' ' || w[4] || ' -' || w[5] || ' OR "' || w[-2] || ' ' || w[-1] || '" ' || w[1] AS query FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)"""


def box_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.regexp_extract_all("text", F.lit(fulltext.TERM), F.lit(0))
    at = lambda k: F.try_element_at(w, F.lit(k))
    said = F.concat(F.lit('"'), at(1), F.lit(" "), at(2), F.lit('" or '), at(3), F.lit(" "), at(4), F.lit(" -"), at(5), F.lit(' OR "'), at(-2), F.lit(" "), at(-1), F.lit('" '), at(1))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), said.alias("query"))


@query(f"SELECT query_id, chunk_id, round(score, 9) AS score, rank::INTEGER AS rank FROM ({search_sql(_BOX, _CHUNKS)})")
def websearch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes, alternatives and exclusions, ranked among active chunks."""
    return fulltext.search(box_queries(spark, sf_dir), chunks(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(f"SELECT query_id, chunk_id, round(score, 9) AS score FROM ({matches_sql(_BOX, _CHUNKS)})")
def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk that satisfies a box query, scored by how close together its words stand."""
    return fulltext.matches(box_queries(spark, sf_dir), chunks(spark, sf_dir)).withColumn("score", F.round("score", 9))


_DOT = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))"
_DENSE = """
SELECT query_id, chunk_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
  SELECT {query} AS query_id, v.vec_id AS chunk_id, {dot} AS score, row_number() OVER (PARTITION BY {query} ORDER BY {dot} DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE {where}) WHERE rank <= {k}"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


@query(_DENSE.format(query="q.vec_id", dot=_DOT, where="q.vec_id % 50 = 0", k=fixed.DENSE_LIMIT))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 is a query, against all vectors."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.dense_candidates(asked, _vectors(spark, sf_dir)).withColumn("score", F.round("score", 6))


ANN_RECALL, ANN_K = 0.95, 20


def _ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all vectors, with as many probes as the recall asks for."""
    folder = f"{scratch_folder(spark)}/index"
    vectors = _vectors(spark, sf_dir)
    vector_index.build(vectors, folder)
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index.search(asked, folder, vector_index.calibrated(vectors, folder, ANN_RECALL, ANN_K), ANN_K)


@query()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate neighbours of every vector whose id is divisible by 50, over all vectors."""
    return _ann(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"SELECT count(*)::BIGINT AS wanted, true AS enough FROM (SELECT query_id FROM ({_DENSE.format(query='q.vec_id', dot=_DOT, where='q.vec_id % 50 = 0', k=ANN_K)}))")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds ANN_RECALL of the exact neighbours."""
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = retrieve.dense_candidates(asked, _vectors(spark, sf_dir), ANN_K).select("query_id", "chunk_id")
    found = exact.join(_ann(spark, sf_dir).select("query_id", "chunk_id", F.lit(1).alias("found")), ["query_id", "chunk_id"], "left")
    return found.agg(F.count(F.lit(1)).alias("wanted"), (F.count("found") >= ANN_RECALL * F.count(F.lit(1))).alias("enough"))


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id")
    asked = items.join(table(spark, sf_dir, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")
    return retrieve.dense_candidates(asked, _vectors(spark, sf_dir))


_DENSE_ITEMS = _DENSE.format(query="q.vec_id", dot=_DOT, where="q.vec_id IN (SELECT item_id FROM benchmark)", k=fixed.DENSE_LIMIT)
_FUSED = f"""
WITH ex AS ({_EXACT}), le AS ({_LEXICAL}), de AS ({_DENSE_ITEMS}),
a AS (SELECT query_id, chunk_id, 'exact' AS channel, 0 AS place, rank, 2.0::DOUBLE / (60 + rank) AS share FROM ex UNION ALL SELECT query_id, chunk_id, 'lexical', 1, rank, 1.0::DOUBLE / (60 + rank) FROM le
  UNION ALL SELECT query_id, chunk_id, 'dense', 2, rank, 1.0::DOUBLE / (60 + rank) FROM de),
f AS (SELECT query_id, chunk_id, sum(share) AS score, max_by(channel, place) AS last_channel, string_agg(channel || ':' || rank, '+' ORDER BY channel) AS ranks FROM a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM f)
SELECT query_id, chunk_id, round(score, 9) AS score, last_channel, ranks, rank::INTEGER AS rank FROM r WHERE rank <= {{k}}"""


def _fused(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieve.fused({"exact": _exact(spark, sf_dir), "lexical": _lexical(spark, sf_dir), "dense": _dense(spark, sf_dir)}, k=k)


def _shown(df: DataFrame) -> DataFrame:
    ranks = F.array_join(F.transform(F.array_sort(F.map_entries("ranks")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), "+")
    return df.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "last_channel", ranks.alias("ranks"), "rank")


@query(_FUSED.replace("{k}", str(fixed.CANDIDATE_LIMIT)))
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_fused(spark, sf_dir, fixed.CANDIDATE_LIMIT))


@query(f"""
WITH f AS ({_FUSED.replace("{k}", str(fixed.FUSED_LIMIT))}), c AS ({_CHUNKS})
SELECT f.*, c.document_id, c.canonical_reference_id FROM f JOIN c ON c.chunk_id = f.chunk_id AND c.is_active""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: three channels fused for every benchmark item, then looked up; inactive chunks drop out after the cut."""
    found = _shown(_fused(spark, sf_dir, fixed.FUSED_LIMIT))
    return retrieve.hydrated(found, chunks(spark, sf_dir)).select(*found.columns, "document_id", "canonical_reference_id")


@query(f"""
WITH i AS (SELECT DISTINCT normalized_identifier FROM ({_INDEX})), w AS (SELECT DISTINCT query_id, normalized_identifier FROM ({_WANTED}))
SELECT query_id, count(i.normalized_identifier) = count(*) AS resolved FROM w LEFT JOIN i USING (normalized_identifier) GROUP BY query_id""")
def unresolved_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.resolved_queries(wanted(spark, sf_dir), index.identifier_rows(chunks(spark, sf_dir)))


@query(f"""
WITH t AS (SELECT query_id, chunk_id, rank FROM ({_DENSE.format(query="q.vec_id", dot=_DOT, where="q.vec_id % 50 = 0", k=fixed.DENSE_LIMIT)})), c AS ({_CHUNKS})
SELECT t.query_id, t.chunk_id, t.rank, c.document_id FROM t JOIN c USING (chunk_id) WHERE c.is_active""")
def order_preserving_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top k first, then the join and the filter, so fewer than k may come back."""
    top = dense_topk(spark, sf_dir).select("query_id", "chunk_id", "rank")
    return retrieve.hydrated(top, chunks(spark, sf_dir)).select("query_id", "chunk_id", "rank", "document_id")


# Candidates to rerank: the fused retrieval's chunks that are active, numbered anew, with a class of authority each.
CLASSES = list(fixed.AUTHORITY_WEIGHTS) + ["other"]
_CANDIDATES = f"""SELECT r.query_id, b.text AS query, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank)::INTEGER AS rank, c.chunk_id AS doc_id, c.text AS content, c.contextual_header, r.ranks,
  ([{", ".join(map(quoted, CLASSES))}])[(c.chunk_id % {len(CLASSES)})::INTEGER + 1] AS source_class FROM ({_FUSED.replace("{k}", str(fixed.CANDIDATE_LIMIT))}) r JOIN ({_CHUNKS}) c ON c.chunk_id = r.chunk_id AND c.is_active JOIN benchmark b ON b.item_id = r.query_id"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, rank, doc_id, content, contextual_header, ranks, source_class): ids are ranked first, texts fetched for what is left."""
    found = _shown(_fused(spark, sf_dir, fixed.CANDIDATE_LIMIT)).select("query_id", "chunk_id", "ranks", "rank")
    kinds = F.array(*map(F.lit, CLASSES))
    live = chunks(spark, sf_dir).select("chunk_id", "is_active", "contextual_header", F.col("text").alias("content"))
    rows = retrieve.hydrated(found, live).join(items(spark, sf_dir), "query_id").withColumn("source_class", F.get(kinds, (F.col("chunk_id") % len(CLASSES)).cast("int")))
    return retrieve.top(rows.withColumnRenamed("rank", "fused"), ["query_id"], [F.asc("fused")], fixed.CANDIDATE_LIMIT).withColumnRenamed("chunk_id", "doc_id").select("query_id", "query", "rank", "doc_id", "content", "contextual_header", "ranks", "source_class")


_WEIGHT = "CASE source_class " + " ".join(f"WHEN {quoted(c)} THEN {w}" for c, w in fixed.AUTHORITY_WEIGHTS.items()) + f" ELSE {fixed.OTHER_AUTHORITY} END"
_SIGNALS = f"""
WITH c AS (SELECT * FROM ({_CANDIDATES}) WHERE rank <= {fixed.CANDIDATE_LIMIT}),
t AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{{2,}}')) AS q, list_distinct(list_concat(regexp_extract_all(lower(content), '[a-z0-9]{{2,}}'), regexp_extract_all(lower(contextual_header), '[a-z0-9]{{2,}}'))) AS h,
  len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) AS words, len(regexp_extract_all(content, {quoted(fixed.LEGAL_MARKERS)})) AS markers FROM c),
s AS (SELECT *, round(least(1.0::DOUBLE, len(list_intersect(q, h))::DOUBLE / greatest(1, len(q)) * 1.2::DOUBLE), 4) AS relevant,
  round(least(1.0::DOUBLE, 0.4::DOUBLE + markers::DOUBLE / greatest(1, words) * 3.0::DOUBLE) * CASE WHEN words < 15 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 4) AS bearing,
  ({_WEIGHT})::DOUBLE AS fit, CASE WHEN contains(content, '1997') OR contains(content, '202') THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END AS fresh FROM t)
SELECT *, round(0.45::DOUBLE * relevant + 0.30::DOUBLE * bearing + 0.15::DOUBLE * fit + 0.10::DOUBLE * fresh, 6) AS composite FROM s"""


@query(f"SELECT query_id, doc_id, rank, composite, reranked::INTEGER AS reranked FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, rank) AS reranked FROM ({_SIGNALS})) WHERE reranked <= {fixed.CHILD_LIMIT}")
def heuristic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.reranked(candidates(spark, sf_dir)).select("query_id", "doc_id", "rank", "composite", "reranked")


@query(f"""
WITH RECURSIVE c AS (SELECT query_id, rank, doc_id, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]{{2,}}')) AS terms FROM ({_CANDIDATES}) WHERE rank <= {fixed.CANDIDATE_LIMIT}),
f AS (SELECT query_id, rank, doc_id, true AS taken, [terms] AS kept FROM c WHERE rank = 1
  UNION ALL SELECT query_id, rank, doc_id, NOT twin, CASE WHEN twin THEN kept ELSE list_append(kept, terms) END FROM
    (SELECT c.*, f.kept, len(list_filter(f.kept, lambda k: CASE WHEN len(k) + len(c.terms) = 0 THEN true
      ELSE len(list_intersect(k, c.terms)) / (len(k) + len(c.terms) - len(list_intersect(k, c.terms))) >= {fixed.NEAR_DUPLICATE} END)) > 0 AS twin FROM f JOIN c ON c.query_id = f.query_id AND c.rank = f.rank + 1))
SELECT query_id, rank::INTEGER AS rank, doc_id FROM f WHERE taken""")
def near_duplicates_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.deduplicated(candidates(spark, sf_dir)).select("query_id", "rank", "doc_id")


_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Nl}_]+(?:[''’\-][\p{L}\p{M}\p{Nd}\p{Nl}_]+)*|[^\p{L}\p{M}\p{Nd}\p{Nl}_\s]'))"
_RERANKED = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, rank) AS reranked FROM ({_SIGNALS})"


@query(f"""
WITH RECURSIVE k AS (SELECT query_id, 'p' || doc_id // 4 AS parent_id, min(reranked) AS at_ FROM ({_RERANKED}) WHERE reranked <= {fixed.CHILD_LIMIT} GROUP BY ALL),
u AS (SELECT 'p' || doc_id // 4 AS parent_id, sum({_TOKENS}) AS units FROM documents GROUP BY ALL),
o AS (SELECT query_id, parent_id, units, row_number() OVER (PARTITION BY query_id ORDER BY at_, parent_id) AS n FROM k JOIN u USING (parent_id)),
f AS (SELECT query_id, n, parent_id, units, true AS taken, 1 AS kept, units AS total FROM o WHERE n = 1
  UNION ALL SELECT o.query_id, o.n, o.parent_id, o.units, f.kept < {fixed.MAX_EVIDENCE} AND f.total + o.units <= {fixed.TOKEN_BUDGET},
    f.kept + (f.kept < {fixed.MAX_EVIDENCE} AND f.total + o.units <= {fixed.TOKEN_BUDGET})::INT, f.total + CASE WHEN f.kept < {fixed.MAX_EVIDENCE} AND f.total + o.units <= {fixed.TOKEN_BUDGET} THEN o.units ELSE 0 END
    FROM f JOIN o ON o.query_id = f.query_id AND o.n = f.n + 1)
SELECT query_id, kept::INTEGER AS ordinal, 'E' || kept AS evidence_id, parent_id, units::BIGINT AS text_units, total::BIGINT AS used_units FROM f WHERE taken""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents are groups of four documents; a parent's size is the tokens of its documents."""
    kids = rerank.reranked(candidates(spark, sf_dir)).select("query_id", "reranked", F.concat(F.lit("p"), F.floor(F.col("doc_id") / 4).cast("string")).alias("parent_id"))
    parents = table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 4).cast("string")).alias("parent_id")).agg(F.sum(T.token_count(F.col("text"))).alias("text_units"))
    return rerank.budgeted(kids, parents)


@query(f"""
WITH c AS (SELECT * FROM ({_CANDIDATES}) WHERE rank <= {fixed.CANDIDATE_LIMIT}), k AS (SELECT query_id, 'p' || doc_id // 4 AS parent_id, min(rank) AS first FROM c GROUP BY ALL)
SELECT query_id, parent_id, first::INTEGER AS first, p.members FROM k JOIN (SELECT 'p' || doc_id // 4 AS parent_id, count(*)::BIGINT AS members FROM documents GROUP BY ALL) p USING (parent_id)""")
def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parents of candidates in the order of their first child."""
    parent = F.concat(F.lit("p"), F.floor(F.col("doc_id") / 4).cast("string"))
    kids = candidates(spark, sf_dir).groupBy("query_id", parent.alias("parent_id")).agg(F.min("rank").alias("first"))
    return kids.join(table(spark, sf_dir, "documents").groupBy(parent.alias("parent_id")).agg(F.count(F.lit(1)).alias("members")), "parent_id").select("query_id", "parent_id", "first", "members")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, evidence): the first five reranked candidates of each item as evidence units."""
    five = rerank.reranked(candidates(spark, sf_dir), 5)
    unit = F.struct(
        "reranked", F.concat(F.lit("E"), "reranked").alias("evidence_id"), F.concat(F.lit("doc"), "doc_id").alias("document_id"), F.lit("v1").alias("version_id"), F.concat(F.lit("p"), "doc_id").alias("parent_id"), F.col("source_class").alias("citation_label"),
        F.col("contextual_header").alias("title"), F.lit("https://example.org/").alias("source_url"), F.lit(None).cast("string").alias("section_id"), F.concat(F.regexp_replace("ranks", ":[0-9]+", ""), F.lit("+reranker")).alias("retrieval_reason"), F.col("composite").alias("reranker_score"), F.col("content").alias("text"),
    )
    return five.groupBy("query_id").agg(F.first("query").alias("query"), F.sort_array(F.collect_list(unit)).alias("evidence"))


_UNITS = f"SELECT query_id, query, doc_id, reranked, composite, content, contextual_header AS title, source_class AS label, contains(ranks, '+') AND regexp_matches(ranks, 'exact|lexical') AS agrees FROM ({_RERANKED}) WHERE reranked <= 5"
_STOP = "[" + ", ".join(map(quoted, fixed.STOP_WORDS)) + "]"


@query(f"""
WITH e AS (SELECT query_id, trim(query) AS q, string_agg(lower(content), ' ' ORDER BY reranked) AS corpus, max(composite) AS best, bool_or(agrees) AS agreement, flatten(list([label, title])) AS labels FROM ({_UNITS}) GROUP BY ALL),
w AS (SELECT *, list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda x: NOT list_contains({_STOP}, x) AND length(x) > 2) AS words, list_filter({identifiers_sql("q")}, lambda x: x <> '') AS asked,
  list_transform(labels, lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS known, {LETTERS} AS plain FROM e),
c AS (SELECT *, len(list_filter(words, lambda x: contains(corpus, x))) / len(words) AS coverage FROM w)
SELECT query_id, CASE WHEN regexp_matches(plain, {quoted(fixed.FOREIGN_QUERY)}) OR regexp_matches(plain, {quoted(fixed.SPECULATIVE_QUERY)}) THEN 'INADEQUATE'
  WHEN len(asked) > 0 THEN CASE WHEN len(list_filter(asked, lambda x: NOT list_contains(known, x))) = 0 THEN 'ADEQUATE' ELSE 'INADEQUATE' END
  WHEN len(words) = 0 THEN 'INADEQUATE' WHEN agreement AND best >= 0.7 THEN 'ADEQUATE' WHEN coverage < 0.35 AND NOT agreement THEN 'INADEQUATE' WHEN coverage < 0.5 AND best < 0.15 THEN 'WEAK' ELSE 'ADEQUATE' END AS status,
  coalesce(nullif(array_to_string(list_filter(string_split_regex(q, '\\s+'), lambda x: NOT list_contains({_STOP}, lower(x)) AND x <> ''), ' '), ''), q) AS retry FROM c""")
def evidence_adequacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("query_id", answer.adequacy(F.col("query"), F.col("evidence")).alias("status"), answer.rewritten(F.col("query")).alias("retry"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evidence(spark, sf_dir).withColumn("claims", answer.extracted_claims(F.col("evidence")))
    return df.withColumn("answer_markdown", answer.rendered(F.col("claims"))).withColumn("limitations", F.array(F.lit("extracted sentences only")))


@query(f"""
WITH u AS (SELECT *, list_filter(string_split(regexp_replace(trim(content), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 30) AS sentences FROM ({_UNITS}) WHERE reranked <= 4),
l AS (SELECT *, coalesce(trim(sentences[1]), substr(trim(content), 1, 200)) AS lead FROM u),
t AS (SELECT *, list_distinct(regexp_extract_all(lower(lead), '[a-z0-9]{{2,}}')) AS terms, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]{{2,}}')) AS held FROM l),
s AS (SELECT *, least(1.0::DOUBLE, len(list_filter(terms, lambda w: list_contains(held, w) OR length(w) >= 4 AND contains(lower(content), substr(w, 1, 4)))) / greatest(1, len(terms)) * 1.5::DOUBLE) AS support FROM t),
a AS (SELECT query_id, list_distinct(regexp_extract_all(lower(any_value(query)), '[a-z0-9]{{2,}}')) AS q, list_distinct(regexp_extract_all(lower(string_agg(lead || ' [E' || reranked || ']', ' ' ORDER BY reranked)), '[a-z0-9]{{2,}}')) AS m,
  avg(support) AS support, count(*) FILTER (trim(lead) = '') AS errors, count(*) AS n FROM s GROUP BY query_id),
r AS (SELECT *, round(least(1.0::DOUBLE, len(list_intersect(q, m)) / greatest(1, len(q))), 4) AS rel, round(support, 4) AS sup FROM a)
SELECT query_id, n::INTEGER AS n_claims, errors::INTEGER AS n_errors, CASE WHEN errors = 0 THEN 'SUPPORTED' ELSE 'PARTIALLY_SUPPORTED' END AS evidence_state, sup AS evidence_support, rel AS relevance,
  round(0.40::DOUBLE * sup + 0.30::DOUBLE * 0.95::DOUBLE + 0.20::DOUBLE * rel + 0.10::DOUBLE * (1 - round(greatest(0.0::DOUBLE, 1 - support), 4)), 4) AS overall FROM r""")
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = answers(spark, sf_dir)
    v = answer.validation(F.col("answer_markdown"), F.col("claims"), F.col("evidence"))
    j = answer.judged(F.col("query"), F.col("answer_markdown"), F.col("claims"), F.col("limitations"), F.col("evidence"))
    return df.select("query_id", F.size("claims").alias("n_claims"), v.alias("v"), j.alias("j")).select("query_id", "n_claims", F.size("v.errors").alias("n_errors"), "v.evidence_state", "j.evidence_support", "j.relevance", "j.overall")


@query(f"""
WITH r AS ({_RERANKED}) SELECT query_id, 'cit_0' || reranked AS citation_id, 'E' || reranked AS evidence_id, 'doc' || doc_id AS document_id,
  ([{", ".join(map(quoted, CLASSES))}])[(doc_id % {len(CLASSES)})::INTEGER + 1] AS display FROM r WHERE reranked <= 4""")
def citation_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer.citations(answers(spark, sf_dir))


@query("SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'INSUFFICIENT_EVIDENCE' ELSE 'PARTIALLY_SUPPORTED' END AS evidence_state, CASE item_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS n_errors FROM benchmark")
def answer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as claims: with their evidence, without any, or with a citation of evidence that is not there."""
    k = F.col("item_id") % 3
    values_ = ("E1", "d", "v", "p", "label", "title", "https://example.org/", None, "exact", 0.5)
    names = [f.split(":")[0] for f in answer.EVIDENCE.removeprefix("array<struct<").removesuffix(">>").split(",")]
    unit = F.struct(*(F.lit(v).cast("string" if v is None else "double" if isinstance(v, float) else "string").alias(n) for v, n in zip(values_, names)), F.col("text").alias(names[-1]))
    evidence_ = F.when(k == 1, F.array().cast(answer.EVIDENCE)).otherwise(F.array(unit))
    said = F.array(F.struct(F.lit("c1").alias("claim_id"), F.col("text"), F.when(k == 2, F.array(F.lit("E1"), F.lit("E9"))).otherwise(F.array(F.lit("E1"))).alias("evidence_ids")))
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), answer.validation(F.lit("said"), said, evidence_).alias("v"))
    return rows.select("query_id", "v.evidence_state", F.size("v.errors").alias("n_errors"))
