"""Queries on chunking, court pages, tenants, limits, windows and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators import chunk, corpus, court, gates, index
from evidara.plans.registry import query, table
from evidara.streaming import machines, windows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test documents in the ready form: one section each."""
    d = table(spark, sf_dir, "documents")
    section = F.struct(F.lit("s1").alias("section_id"), F.lit("Section").alias("heading"), F.array(F.lit("Part"), F.lit("Section")).alias("heading_path"), F.col("text"))
    cells = F.struct(F.lit("t1").alias("table_id"), F.lit("s1").alias("section_id"), F.lit(1).alias("page_number"), F.array(F.lit("lang"), F.lit("source")).alias("headers"), F.array(F.array("lang", "source"), F.array("source", "lang")).alias("matrix"))
    return d.select(F.concat(F.lit("doc"), "doc_id").alias("document_id"), F.sha2("text", 256).alias("version_id"), F.concat("lang", F.lit(" "), "source").alias("title"), F.array(section).alias("sections"), F.when(F.col("doc_id") % 10 == 0, F.array(cells)).alias("tables"))


@query()
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["document_id", "chunk_id", "parent_id", "chunk_index", "chunk_type", "char_start", "char_end", "row_start", "row_end", "text_units"]
    return chunk.chunked(documents(spark, sf_dir), columns=wanted).select(*wanted)


@query("SELECT check_name AS \"check\", 0::BIGINT AS failures FROM (VALUES ('duplicate_chunk_id'), ('missing_parent'), ('sizing'), ('empty_text'), ('missing_lineage'), ('locator')) v(check_name)")
def chunk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound export has no failures: located characters are held against the source texts."""
    d = documents(spark, sf_dir)
    sections = d.select("document_id", F.explode("sections").alias("s")).select("document_id", "s.section_id", "s.text")
    return chunk.audit(chunk.chunked(d, columns=chunk.AUDITED), sections)


@query()
def chunk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.parents_of(chunk.chunked(documents(spark, sf_dir))).select("document_id", "parent_id", "parent_index", "text_units", "children")


@query(r"""
WITH c AS (SELECT doc_id, substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 650) AS s FROM documents), p AS (SELECT doc_id, regexp_extract(s, '(?s)^(.*[.!?])(?:\s|$)', 1) AS p FROM c)
SELECT doc_id, p AS passage, 0 AS starts_at FROM p WHERE length(p) >= 120""")
def passage_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.passages(table(spark, sf_dir, "documents"), "doc_id", "text")


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return court.pages_to_blocks(table(spark, sf_dir, "pages")).select("page_id", "title", F.size("blocks").alias("n_blocks"), F.sha2(F.array_join("blocks", "\n"), 256).alias("digest"))


_HEAD = r"'(?s)^\s*\[?(\d{1,4})\]?\s+(.+)$'"
_OPENS = "coalesce(TRY_CAST(num AS INT) > last AND TRY_CAST(num AS INT) <= last + 3, false)"


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN '[' || ((i - 1) // 3 + 1) || '] ' || x ELSE x END) AS b FROM documents),
f AS (SELECT doc_id, 0 AS i, 0 AS last, '' AS text, []::STRUCT(n INT, t VARCHAR)[] AS done FROM d
  UNION ALL SELECT doc_id, i, CASE WHEN {_OPENS} THEN TRY_CAST(num AS INT) ELSE last END,
    CASE WHEN {_OPENS} THEN trim(body, ' ') WHEN last > 0 THEN trim(text || ' ' || x, ' ') ELSE '' END, CASE WHEN {_OPENS} AND last > 0 THEN list_append(done, {{'n': last, 't': text}}) ELSE done END FROM
    (SELECT f.doc_id, f.i + 1 AS i, f.last, f.text, f.done, d.b[f.i + 1] AS x, regexp_extract(d.b[f.i + 1], {_HEAD}, 1) AS num, regexp_extract(d.b[f.i + 1], {_HEAD}, 2) AS body FROM f JOIN d USING (doc_id) WHERE f.i < len(d.b))),
p AS (SELECT f.doc_id, unnest(CASE WHEN f.last > 0 THEN list_append(f.done, {{'n': f.last, 't': f.text}}) ELSE f.done END) AS p FROM f JOIN d USING (doc_id) WHERE f.i = len(d.b))
SELECT doc_id, p.n AS number, length(p.t)::INTEGER AS n_chars FROM p WHERE len(list_filter(string_split_regex(p.t, '\\s+'), lambda w: w <> '')) >= 5""")
def numbered_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks are the lines of a document, each third one numbered."""
    lines = F.transform(F.split("text", "\n"), lambda x, k: F.when(k % 3 == 0, F.concat(F.lit("["), (F.floor(k / 3) + 1).cast("string"), F.lit("] "), x)).otherwise(x))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(court.numbered_paragraphs(lines)).alias("p"))
    return d.select("doc_id", "p.number", F.length("p.text").alias("n_chars"))


@query()
def court_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as judgments: their title stands for the citation."""
    p = court.pages_to_blocks(table(spark, sf_dir, "pages")).join(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source_url")), "page_id")
    numbered = F.transform("blocks", lambda b, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), b))
    ready = court.ready_documents(p.select("source_url", F.lit("Court").alias("court"), F.col("title").alias("citation"), "title", numbered.alias("blocks")))
    return ready.select("document_id", "version_id", F.size("sections").alias("n_sections"))


_MATTERS = "SELECT c_custkey AS matter_id, CASE WHEN c_nationkey = 24 THEN '' ELSE c_nationkey::VARCHAR END AS tenant_id FROM customer"


def _matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("matter_id"), F.when(F.col("c_nationkey") == 24, "").otherwise(F.col("c_nationkey").cast("string")).alias("tenant_id"))


@query(f"SELECT matter_id, tenant_id FROM ({_MATTERS}) WHERE tenant_id = '7'")
def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.tenant_rows(_matters(spark, sf_dir), "7")


@query("SELECT 0::BIGINT AS rows_unset, 0::BIGINT AS rows_empty")
def tenant_scope_unset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No tenant or an empty one sees nothing."""
    m = _matters(spark, sf_dir)
    unset, empty = (gates.tenant_rows(m, t).agg(F.count(F.lit(1)).alias(n)) for t, n in ((None, "rows_unset"), ("", "rows_empty")))
    return unset.join(F.broadcast(empty), F.lit(True))  # one row each


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "value", (F.col("event_type") == "error").alias("failed"))


@query("""
WITH c AS (SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS at_s FROM events)
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY at_s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING)::BIGINT AS load FROM c""")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machines.offered_load(_calls(spark, sf_dir), "user_id", 86_400).select("event_id", "load")


_ORDERED = "SELECT event_id, user_id, epoch(date_trunc('second', ts))::BIGINT AS s, coalesce(value, 0) AS cost, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)), event_id) AS n FROM events"


@query(f"""
WITH RECURSIVE o AS ({_ORDERED}),
f AS (SELECT user_id, n, event_id, true AS admitted, [s] AS kept FROM o WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, len(live) < 2, CASE WHEN len(live) < 2 THEN list_append(live, s) ELSE live END FROM
    (SELECT o.user_id, o.n, o.event_id, o.s, list_filter(f.kept, lambda t: t > o.s - 86400) AS live FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1))
SELECT user_id, event_id, admitted FROM f""")
def rate_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machines.admissions(_calls(spark, sf_dir), "user_id", 2, 86_400.0)


@query(f"""
WITH RECURSIVE o AS ({_ORDERED}),
f AS (SELECT user_id, n, event_id, cost <= 500 AS accepted, CASE WHEN cost <= 500 THEN cost ELSE 0 END AS spent FROM o WHERE n = 1
  UNION ALL SELECT o.user_id, o.n, o.event_id, f.spent + o.cost <= 500, CASE WHEN f.spent + o.cost <= 500 THEN f.spent + o.cost ELSE f.spent END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
SELECT user_id, event_id, accepted, round(spent, 6) AS spent FROM f""")
def spend_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machines.spending(_calls(spark, sf_dir).select("user_id", "event_id", "at", F.coalesce("value", F.lit(0.0)).alias("cost")), "user_id", 500.0)


@query(f"""
WITH RECURSIVE o AS ({_ORDERED}),
f AS (SELECT user_id, n, event_id, CASE WHEN failed THEN 'failed' ELSE 'ok' END AS outcome, 'CLOSED' AS state, failed::INT AS fails, 0::BIGINT AS since FROM o WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, CASE WHEN closed THEN 'rejected' WHEN failed THEN 'failed' ELSE 'ok' END,
    CASE WHEN closed THEN 'OPEN' WHEN NOT failed THEN 'CLOSED' WHEN was = 'OPEN' OR fails + 1 >= 2 THEN 'OPEN' ELSE was END,
    CASE WHEN closed THEN fails WHEN NOT failed THEN 0 ELSE fails + 1 END, CASE WHEN NOT closed AND failed AND (was = 'OPEN' OR fails + 1 >= 2) THEN s ELSE since END FROM
    (SELECT o.user_id, o.n, o.event_id, o.s, o.failed, f.state AS was, f.fails, f.since, f.state = 'OPEN' AND o.s - f.since <= 3600 AS closed FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1))
SELECT user_id, event_id, outcome, state FROM f""")
def circuit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machines.circuit_states(_calls(spark, sf_dir), "user_id", 2, 3_600.0)


_LOG = "SELECT event_id, 'job' || user_id AS job_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'enqueued' END AS event, event_type || event_id AS error_message, ts AS at_ts FROM events"


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("enqueued")
    log = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("job"), "user_id").alias("job_id"), kind.alias("event"), F.concat("event_type", F.col("event_id").cast("string")).alias("error_message"), F.col("ts").cast("timestamp").alias("at"))
    return machines.dead_letters(log)


_LETTERS = f"""SELECT f.job_id, CASE WHEN l.last = 'completed' THEN 'COMPLETED' ELSE 'FAILED' END AS status, error_message, retry_count::BIGINT AS retry_count, created_at FROM
  (SELECT job_id, count(*) - 1 AS retry_count, max_by(error_message, event_id) AS error_message, min(at_ts) AS created_at FROM ({_LOG}) WHERE event <> 'completed' GROUP BY job_id) f
  JOIN (SELECT job_id, max_by(event, event_id) AS last FROM ({_LOG}) GROUP BY job_id) l USING (job_id)"""


@query(f"SELECT job_id, status, error_message, retry_count FROM ({_LETTERS})")
def dlq_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir).select("job_id", "status", "error_message", "retry_count")


@query(f"SELECT job_id, retry_count FROM ({_LETTERS}) WHERE status = 'FAILED' ORDER BY created_at, job_id LIMIT 50")
def dlq_replay_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machines.replay_queue(_letters(spark, sf_dir)).select("job_id", "retry_count")


def _text_time(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_time(windows.windowed(table(spark, sf_dir, "events"), "1 hour"), "window_start")


@query("""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total
FROM (SELECT *, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts - INTERVAL 12 HOUR) + INTERVAL 12 HOUR]) AS w FROM events) GROUP BY ALL""")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_time(windows.windowed(table(spark, sf_dir, "events"), "1 day", "12 hours"), "window_start")


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*)::BIGINT AS n FROM s GROUP BY user_id, session""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_time(windows.sessions(table(spark, sf_dir, "events"), "6 hours"), "session_start")


@query("SELECT count(*)::BIGINT AS rows, count(DISTINCT path)::BIGINT AS unique_paths, (count(*) - count(DISTINCT path))::BIGINT AS duplicate_rows, count(*) FILTER (lang = 'en')::BIGINT AS legislation_rows, 0::BIGINT AS missing_paths FROM (SELECT lang, source || '/' || doc_id % 300 AS path FROM documents)")
def index_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), (F.col("doc_id") % 300).cast("string"))
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, path).alias("path"), path.alias("relative_path"), F.when(F.col("lang") == "en", "primary_legislation").alias("corpus"))
    return corpus.index_audit(rows)


@query("SELECT document_id, count(DISTINCT root || '|' || path)::BIGINT AS locations FROM (SELECT doc_id % 700 AS document_id, source AS root, lang AS path FROM documents) GROUP BY document_id HAVING count(DISTINCT root || '|' || path) > 1")
def duplicate_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.located_once(table(spark, sf_dir, "documents").select((F.col("doc_id") % 700).alias("document_id"), F.col("source").alias("root"), F.col("lang").alias("path")))


@query("SELECT term, chunk_id, tf::BIGINT AS tf FROM (SELECT term, item_id AS chunk_id, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS term FROM benchmark) GROUP BY ALL)")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0)).alias("terms"))
    return index.postings(items, "chunk_id", F.col("terms"))
