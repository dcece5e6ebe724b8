"""Queries on fitness for use: passages, questions, gold cases, acceptance, providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import fixed
from evidara.operators import candidates, chunk, court, evaluate, providers
from evidara.operators.lineage import scratch_folder
from evidara.plans.operations import documents
from evidara.plans.registry import planted, planted_sql, query, quoted, table

_BLOCKED = "[" + ", ".join(map(quoted, fixed.BLOCKED_TEXT)) + "]"
_OPEN = "[" + ", ".join(map(quoted, fixed.OPENINGS_WITHOUT_SUBSTANCE)) + "]"


def _substantive_sql(c: str) -> str:
    """Whether a text in a column is of substance, for a clean title and heading."""
    words = f"regexp_extract_all(lower({c}), '[a-z]{{3,}}')"
    return rf"""(len(list_filter({_BLOCKED}, lambda p: contains(lower({c}), p))) = 0 AND len({words}) >= 28 AND len(list_distinct({words})) >= 16 AND regexp_matches(rtrim({c}), '[.!?]$')
  AND regexp_matches(ltrim({c}), '^[A-Z0-9(\-•]') AND NOT regexp_matches({c}, '(?s)^\s*1\s+[A-Za-z].*\b2\s+[A-Za-z]') AND len(list_filter({_OPEN}, lambda p: starts_with(lower({c}), p))) = 0)"""


def _substance(passage: Column) -> Column:
    return candidates.passage_is_substantive(passage, F.lit("A clean title"), F.array(F.lit("Part"), F.lit("Leaf")), F.lit(None).cast("string"), F.lit("Which?"))


@query(f"SELECT doc_id, {_substantive_sql('text')} AS substantive FROM documents")
def substantive_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _substance(F.col("text")).alias("substantive"))


# Four rows are the sections of a document; a line that ends a sentence ends a paragraph.
_SECTIONS = "SELECT doc_id // 4 AS document_id, doc_id AS section_order, regexp_replace(text, '\\.\\n', '.' || chr(10) || chr(10), 'g') AS text FROM documents"
_PARAGRAPHS = rf"""SELECT document_id, section_order, paragraph::INTEGER AS paragraph, (at_ + length(p) - length(regexp_replace(p, '^\s+', '')))::INTEGER AS char_start, regexp_replace(p, '^\s+|\s+$', '', 'g') AS content FROM (
  SELECT *, coalesce(sum(length(p) + 2) OVER (PARTITION BY section_order ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM (SELECT document_id, section_order, unnest(s) AS p, unnest(range(len(s))) AS paragraph FROM (SELECT *, string_split(coalesce(text, ''), chr(10) || chr(10)) AS s FROM ({_SECTIONS}))))"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.floor(F.col("doc_id") / 4).alias("document_id"), F.col("doc_id").alias("section_order"), F.regexp_replace("text", r"\.\n", ".\n\n").alias("text"))


@query(f"SELECT section_order, paragraph, char_start, char_start + length(content) AS char_end, sha256(content) AS digest FROM ({_PARAGRAPHS})")
def paragraph_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every paragraph of every section stands."""
    return chunk.paragraphs(sections(spark, sf_dir), ["section_order"]).select("section_order", "paragraph", "char_start", "char_end", F.sha2("content", 256).alias("digest"))


@query(rf"""
WITH b AS (SELECT *, regexp_extract(substr(content, 1, {fixed.PASSAGE_MOST}), '(?s)^(.*[.!?])(?:\s|$)', 1) AS passage FROM ({_PARAGRAPHS}) WHERE length(content) >= {fixed.PASSAGE_LEAST} AND NOT contains(content, '|')),
f AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section_order, paragraph) AS k FROM b WHERE length(passage) >= {fixed.PASSAGE_LEAST} AND {_substantive_sql("passage")})
SELECT document_id, section_order, paragraph, char_start, char_start + length(passage) AS char_end, passage FROM f WHERE k = 1""")
def first_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first passage of substance, with its section, paragraph, start and end."""
    return chunk.first_passages(sections(spark, sf_dir), _substance)


@query(r"SELECT item_id, length(q) BETWEEN 25 AND 260 AND length(q) - length(replace(q, '?', '')) = 1 AND ends_with(q, '?') AS sound FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN substr(text, 1, 60) || '?' ELSE text END AS q FROM benchmark)")
def question_soundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("item_id") % 2 == 0, F.concat(F.substring("text", 1, 60), F.lit("?"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", candidates.question_is_sound(q).alias("sound"))


@query("SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z]{3,}'), ' ') AS key FROM documents")
def passage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", candidates.passage_key(F.col("text")).alias("key"))


LABELS = [
    (1, "Guide to deductions", ["Part", "Claiming work expenses"], None, True),
    (2, "Guide", ["Part", "On this page"], None, False),
    (3, "Guide", ["Overview"], None, False),
    (4, "TR 2022/3", ["Taxation Ruling TR 2022/3"], "TR 2022/3", False),
    (5, "Guide", ["Definition: 12 things"], None, False),
    (6, "Guide", ["Question 4"], None, False),
    (7, "Guide", ["Step 2 of many"], None, False),
    (8, "x" * 261, ["Leaf"], None, False),
    (9, "Rates 10% 20% 30% 40%", ["Leaf"], None, False),
    (10, "Contents.....5", ["Leaf"], None, False),
    (11, "Guide", ["Definition: entity"], None, True),
    (12, "Id 1a2b3c4d-1a2b-1a2b-1a2b", ["Leaf"], None, False),
    (13, "Guide", ["Class Determination CR 2020/1"], "CR 2020/1", True),
    (14, "Guide", ["Product  Ruling PR 2020/1"], "PR 2020/1", False),
]


@query(f"SELECT doc_id, n, clean FROM {planted_sql([(r[0], r[4]) for r in LABELS], ['n', 'clean'])}")
def label_cleanliness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one of the cases, held against the outcomes worked out by hand for each."""
    df = planted(spark, sf_dir, [r[:4] for r in LABELS], "n int, title string, path array<string>, reference string")
    return df.select("doc_id", "n", candidates.label_is_clean(F.col("title"), F.col("path"), F.col("reference")).alias("clean"))


@query("""
SELECT CASE WHEN must AND NOT said THEN 'correct_abstention' WHEN must THEN 'false_answer' WHEN said THEN 'correct_answer' ELSE 'false_abstention' END AS outcome, count(*)::BIGINT AS n
FROM (SELECT doc_id % 3 = 0 AS must, doc_id % 4 <> 0 AND quality > 0 AS said FROM labels) GROUP BY ALL""")
def acceptance_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    outcome = candidates.acceptance(i % 3 == 0, i % 4 == 0, F.col("quality"))
    return table(spark, sf_dir, "labels").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT l_linenumber AS before, CASE WHEN l_tax < 0.07 THEN l_quantity::INTEGER END AS after, l_extendedprice AS ms FROM lineitem),
o AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i, count(*) OVER () AS n FROM c)
SELECT count(*)::BIGINT AS cases, round(sum(1 / before) / count(*), 4) AS first_stage_mrr, round(count(*) FILTER (before <= 20) / count(*), 4) AS first_stage_recall, round(sum(coalesce(1 / after, 0)) / count(*), 4) AS reranked_mrr,
  round(count(*) FILTER (after BETWEEN 1 AND 20) / count(*), 4) AS reranked_recall, round(count(*) FILTER (before <= 80 AND after BETWEEN 1 AND 20) / count(*) FILTER (before <= 80), 4) AS retention,
  (SELECT max(ms) FILTER (i = round_even((n - 1) * 0.5, 0)::BIGINT) FROM o) AS latency_p50, (SELECT max(ms) FILTER (i = round_even((n - 1) * 0.95, 0)::BIGINT) FROM o) AS latency_p95 FROM c""")
def reranker_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cases = li.select(F.col("l_linenumber").alias("before"), F.when(F.col("l_tax") < 0.07, F.col("l_quantity").cast("int")).alias("after"), F.array(F.lit(1)).alias("relevances"), F.col("l_extendedprice").alias("latency_ms"), F.lit(1).alias("tokens"), F.lit(0.0).alias("cost"))
    return evaluate.reranker_report(cases).drop("ndcg", "latency_mean", "tokens", "cost")


@query("""
SELECT round(count(*) FILTER ((doc_id % 4 = 0) = (doc_id % 3 = 0)) / count(*), 4) AS abstention_accuracy, round(count(*) FILTER (doc_id % 3 = 0 AND doc_id % 4 <> 0) / count(*) FILTER (doc_id % 3 = 0), 4) AS false_answer_rate,
  round(count(*) FILTER (quality > 0) / count(*), 4) AS context_hit_rate, round(avg(quality), 4) AS mean_context_units FROM labels""")
def adversarial_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return evaluate.abstention_rates(table(spark, sf_dir, "labels").select((i % 3 == 0).alias("must_abstain"), (i % 4 == 0).alias("abstained"), F.col("quality").alias("n_units")))


@query("SELECT event_type AS metric, count(*)::BIGINT AS cases, round(avg((value >= 50)::INT), 4) AS success_rate, round(avg(value), 4) AS mean_score FROM events WHERE value IS NOT NULL GROUP BY event_type")
def metric_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metric_successes(table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("metric"), F.col("value").alias("score"), F.lit(50.0).alias("threshold")))


@query("SELECT item_id AS id, CASE WHEN item_id % 5 = 0 THEN 'corrected' ELSE text END AS question FROM benchmark")
def benchmark_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    return evaluate.corrected(b, b.where("id % 5 = 0").withColumn("question", F.lit("corrected")), ["question"])


@query("SELECT 'd' || item_id AS id, CASE WHEN item_id % 4 = 1 THEN 'references an unknown document' WHEN item_id % 4 = 2 THEN 'passage is not an exact source span' WHEN item_id % 4 = 3 THEN 'has an invalid passage span' END AS fault FROM benchmark")
def gold_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item is a document whose passage is its first 30 characters, with a fault planted in three of four."""
    b = table(spark, sf_dir, "benchmark").withColumn("document_id", F.concat(F.lit("d"), "item_id")).withColumn("k", F.col("item_id") % 4)
    src = b.select("document_id", F.lit("v").alias("version_id"), F.lit("s").alias("section_id"), "text")
    p = F.struct(
        F.when(F.col("k") == 1, "nowhere").otherwise(F.col("document_id")).alias("document_id"), F.lit("v").alias("version_id"), F.lit("s").alias("section_id"), F.lit(0).alias("char_start"),
        F.when(F.col("k") == 3, 1_000_000).otherwise(30).alias("char_end"), F.when(F.col("k") == 2, "other").otherwise(F.substring("text", 1, 30)).alias("text"),
    )
    cases = b.select(F.col("document_id").alias("id"), F.lit("A question?").alias("question"), F.lit(False).alias("must_abstain"), F.array(p).alias("passages"))
    kids = src.select("document_id", "section_id", F.lit("text").alias("chunk_type"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"))
    return candidates.gold_faults(cases, src, kids)


@query("SELECT 0::BIGINT AS failures, count(*)::BIGINT AS chunks FROM documents WHERE doc_id % 10 = 0")
def table_locator_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    faults = chunk.table_locator_fault(chunk.chunked(d), chunk.lines_of_tables(d))
    return faults.agg(F.count("fault").alias("failures"), F.count(F.lit(1)).alias("chunks"))


@query("SELECT doc_id, sha256(text) AS input_sha256, 1.0::DOUBLE AS norm FROM documents WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''")
def provider_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents from the local provider, in micro-batches, with what identifies their input."""
    e = providers.embedded(table(spark, sf_dir, "documents"), "doc_id", "text", providers.local_embedding(16), 16)
    return e.select("doc_id", "input_sha256", F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 3).alias("norm"))


@query("SELECT doc_id, sha256(text) AS input_sha256, 1.0::DOUBLE AS norm, 'paused, complete, complete' AS runs FROM documents WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''")
def embedding_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents from a run that was stopped after two commits, one that went on, and one that found nothing to do."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.sha2("text", 256).alias("embedding_input_sha256")).where(F.trim("text") != "")
    folder, size = f"{scratch_folder(spark)}/vectors", max(1, docs.count() // 6)
    runs = [providers.resumable_run(docs, folder, "local-16", providers.local_embedding(16), 16, rows=size, most=most)["status"] for most in (2, None, None)]
    norm = F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 3)
    return providers.committed(spark, folder).select(F.col("chunk_id").alias("doc_id"), "input_sha256", norm.alias("norm"), F.lit(", ".join(runs)).alias("runs"))


@query("SELECT page_id, contains(url, '://') AND starts_with(url, 'https:') AND regexp_matches(url, '^https://[A-Za-z0-9.\\-]*example\\.org[/?#]') AS allowed FROM pages")
def allowed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Https pages of hosts of one domain, the hosts being those that the table has."""
    from evidara.sources.tables import allowed_source

    p = table(spark, sf_dir, "pages")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    return p.select("page_id", (F.coalesce(allowed_source(F.col("url"), ["example.org"]), F.lit(False)) | ((F.try_parse_url("url", F.lit("PROTOCOL")) == "https") & host.endswith(".example.org"))).alias("allowed"))


@query("SELECT doc_id, strftime(make_date(1990 + (doc_id % 30)::INTEGER, (1 + doc_id % 12)::INTEGER, (1 + doc_id % 28)::INTEGER), '%Y-%m-%d') AS day FROM documents")
def decision_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written out in a block of text come back in ISO form."""
    i = F.col("doc_id")
    day = F.make_date((1990 + i % 30).cast("int"), (1 + i % 12).cast("int"), (1 + i % 28).cast("int"))
    text = F.concat(F.lit("Date of judgment: "), F.date_format(day, "d MMMM yyyy"), F.lit(" and 1 May 2030"))
    return table(spark, sf_dir, "documents").select("doc_id", court.decision_date(F.lit("Heard 2 June 1980"), F.array(text)).alias("day"))


@query("SELECT count(*)::BIGINT AS inputs, sum(strlen(text))::BIGINT AS utf8_bytes, ceil(count(*) / 128)::BIGINT AS batches, ceil(sum(strlen(text)) / 4)::BIGINT AS estimated_tokens FROM documents")
def embedding_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidara.operators import corpus

    return corpus.embedding_manifest(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'bad_id' WHEN doc_id % 13 = 0 THEN 'hash_mismatch' WHEN doc_id % 17 = 0 OR trim(text, ' ') = '' THEN 'empty_content' END AS fault FROM documents WHERE doc_id % 7 <> 0")
def active_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidara.operators import corpus

    i = F.col("doc_id")
    h = F.sha2(i.cast("string"), 256)
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(i % 11 == 0, "short").otherwise(h).alias("chunk_id"), F.when(i % 13 == 0, "other").otherwise(h).alias("chunk_hash"), F.when(i % 17 == 0, " ").otherwise(F.col("text")).alias("content"), (i % 7 != 0).alias("is_active"))
    return corpus.active_children(d, True).select("doc_id", "fault")


@query("SELECT 'missing lang' AS fault, count(*) FILTER (doc_id % 9 = 0)::BIGINT AS n FROM documents UNION ALL SELECT 'missing heading', count(*)::BIGINT FROM documents UNION ALL SELECT 'forbidden secret', count(*)::BIGINT FROM documents")
def metadata_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidara.operators import corpus

    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("lang")).alias("lang"), F.lit("x").alias("secret"))
    return corpus.metadata_faults(d, ["lang", "heading", "doc_id"], ["secret", "token"])


@query("SELECT item_id, 'Question: ' || text || chr(10) || chr(10) || '[E1] item ' || item_id || chr(10) || text || chr(10) || chr(10) || '[E2] T' || chr(10) || 'two' AS prompt FROM benchmark")
def prompt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidara.operators import answer

    one = F.struct(F.lit("E1").alias("evidence_id"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("citation_label"), F.lit("T").alias("title"), F.col("text"))
    two = F.struct(F.lit("E2").alias("evidence_id"), F.lit("").alias("citation_label"), F.lit("T").alias("title"), F.lit("two").alias("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", answer.prompt(F.col("text"), F.array(one, two)).alias("prompt"))


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 4 WHEN 0 THEN '' WHEN 1 THEN 'missing limitations, needs_human_review; unknown extra' WHEN 2 THEN 'not JSON; missing answer_markdown, claims, limitations, needs_human_review' ELSE 'missing answer_markdown, claims, limitations, needs_human_review; unknown role, text' END AS faults FROM conversations""")
def answer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as answers: whole, with fields missing and one too many, cut off, or as they are."""
    from evidara.operators import answer

    k, none = (F.col("conv_id") + F.col("turn")) % 4, F.array().cast("array<string>")
    whole = F.to_json(F.struct(F.col("text").alias("answer_markdown"), none.alias("claims"), none.alias("limitations"), F.lit(False).alias("needs_human_review")))
    odd = F.to_json(F.struct(F.col("text").alias("answer_markdown"), none.alias("claims"), F.lit(1).alias("extra")))
    payload = F.when(k == 0, whole).when(k == 1, odd).when(k == 2, F.concat(F.lit("{"), F.substring("text", 1, 9))).otherwise(F.to_json(F.struct("role", "text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(answer.answer_faults(payload), "; ").alias("faults"))


@query(
    "SELECT item_id, array_to_string(list_filter([" + ", ".join(map(quoted, fixed.GOLD_FIELDS)) + "], lambda f: NOT CASE item_id % 4 WHEN 3 THEN false WHEN 2 THEN f IN ('id', 'question') ELSE f <> 'review_status' OR item_id % 4 = 0 END), ', ') AS missing FROM benchmark"
)
def gold_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as gold cases: whole, without a review, with the question alone, or not an object at all."""
    k = F.col("item_id") % 4
    case = lambda fields: F.to_json(F.struct(*((F.col("item_id") if f == "id" else F.col("text") if f == "question" else F.lit("")).alias(f) for f in fields)))
    said = F.when(k == 0, case(fixed.GOLD_FIELDS)).when(k == 1, case([f for f in fixed.GOLD_FIELDS if f != "review_status"])).when(k == 2, case(["id", "question"])).otherwise(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(candidates.missing_gold_fields(said), ", ").alias("missing"))


# A chunk for every document, by doc_id % 16 sound or with one fault planted.
_LOCATED = """SELECT doc_id AS chunk_id, CASE k WHEN 3 THEN 'nowhere' ELSE 'd' || doc_id END AS document_id, CASE WHEN k = 4 THEN 'image' WHEN k BETWEEN 9 AND 14 THEN 'table' ELSE 'text' END AS chunk_type,
  CASE WHEN k IN (7, 13) THEN 'other words' WHEN k BETWEEN 9 AND 14 THEN string_split(text, chr(10))[1] ELSE substr(text, 3, 9) END AS text,
  CASE k WHEN 1 THEN NULL WHEN 2 THEN '[1, 2]' ELSE '{"section_id": "' || CASE k WHEN 5 THEN 'x' ELSE 's' END || '", "char_start": ' || CASE k WHEN 15 THEN '"2"' ELSE '2' END || ', "char_end": ' || CASE k WHEN 6 THEN length(text) + 1 ELSE 2 + length(substr(text, 3, 9)) END
    || ', "table_id": "' || CASE k WHEN 9 THEN 'y' WHEN 10 THEN 'e' ELSE 't' END || '", "row_start": 1, "row_end": ' || CASE k WHEN 11 THEN len(string_split(text, chr(10))) + 1 ELSE 1 END || ', "locator_precision": "' || CASE k WHEN 8 THEN 'near' WHEN 12 THEN 'exact' ELSE CASE WHEN k BETWEEN 9 AND 14 THEN 'table_rows' ELSE 'exact' END END || '"}' END AS source_locator
  FROM (SELECT *, doc_id % 16 AS k FROM documents WHERE length(text) > 11)"""


@query(f"""
WITH c AS ({_LOCATED}), j AS (SELECT c.*, d.text AS source, string_split(d.text, chr(10)) AS own, l ->> '$.section_id' AS section_id, l ->> '$.table_id' AS table_id, l ->> '$.locator_precision' AS precision,
  CASE WHEN json_type(l, '$.char_start') IN ('UBIGINT', 'BIGINT') THEN (l ->> '$.char_start')::BIGINT END AS a, CASE WHEN json_type(l, '$.char_end') IN ('UBIGINT', 'BIGINT') THEN (l ->> '$.char_end')::BIGINT END AS b, (l ->> '$.row_start')::BIGINT AS f, (l ->> '$.row_end')::BIGINT AS g
  FROM (SELECT *, source_locator::JSON AS l FROM c) c LEFT JOIN documents d ON c.document_id = 'd' || d.doc_id)
SELECT chunk_id, CASE WHEN source_locator IS NULL THEN 'missing_source_locator' WHEN json_type(l) <> 'OBJECT' THEN 'invalid_source_locator' WHEN source IS NULL THEN 'unknown_document_id'
  WHEN chunk_type = 'text' THEN CASE WHEN section_id <> 's' THEN 'missing_source_section' WHEN a IS NULL OR b IS NULL OR a < 0 OR a > b OR b > length(source) THEN 'invalid_character_span' WHEN substr(source, a + 1, b - a) <> text THEN 'inexact_character_span' WHEN precision <> 'exact' THEN 'invalid_text_locator_precision' END
  WHEN chunk_type = 'table' THEN CASE WHEN table_id NOT IN ('t', 'e') THEN 'missing_source_table' WHEN table_id = 'e' THEN 'empty_source_table' WHEN f < 1 OR f > g OR g > len(own) THEN 'invalid_table_row_range' WHEN precision <> 'table_rows' THEN 'invalid_table_locator_precision'
    WHEN NOT contains(array_to_string(list_slice(own, f, g), chr(10) || chr(10)), text) THEN 'inexact_table_rows' END
  ELSE 'unknown_chunk_type' END AS fault FROM j""")
def locator_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason why a chunk's locator does not hold in its document, every reason being planted."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 11).withColumn("k", F.col("doc_id") % 16)
    k, lines = F.col("k"), F.split("text", "\n")
    own, of_table = F.concat(F.lit("d"), "doc_id"), F.col("k").between(9, 14)
    pick = lambda cases, other: F.coalesce(*(F.when(k == n, c if isinstance(c, Column) else F.lit(c)) for n, c in cases.items()), other if isinstance(other, Column) else F.lit(other))
    piece = F.substring("text", 3, 9)
    json = F.concat(
        F.lit('{"section_id": "'), pick({5: "x"}, "s"), F.lit('", "char_start": '), pick({15: '"2"'}, "2"), F.lit(', "char_end": '), pick({6: F.length("text") + 1}, 2 + F.length(piece)).cast("string"), F.lit(', "table_id": "'), pick({9: "y", 10: "e"}, "t"),
        F.lit('", "row_start": 1, "row_end": '), pick({11: F.size(lines) + 1}, 1).cast("string"), F.lit(', "locator_precision": "'), pick({8: "near", 12: "exact"}, F.when(of_table, "table_rows").otherwise("exact")), F.lit('"}'),
    )
    children = d.select(
        F.col("doc_id").alias("chunk_id"), pick({3: "nowhere"}, own).alias("document_id"), pick({4: "image"}, F.when(of_table, "table").otherwise("text")).alias("chunk_type"),
        pick({7: "other words", 13: "other words"}, F.when(of_table, F.get(lines, F.lit(0))).otherwise(piece)).alias("text"), F.when(k != 1, pick({2: "[1, 2]"}, json)).alias("source_locator"),
    )
    every = table(spark, sf_dir, "documents").select(own.alias("document_id"), "text")
    rows = F.explode(F.array(F.struct(F.lit("t").alias("table_id"), F.split("text", "\n").alias("lines")), F.struct(F.lit("e").alias("table_id"), F.array().cast("array<string>").alias("lines"))))
    return chunk.locator_faults(children, every, every.withColumn("section_id", F.lit("s")), every.select("document_id", rows.alias("t")).select("document_id", "t.*"))
