"""Queries on joins: orphans, containment, validity, intervals, key checks, incremental upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.operators import evaluate, index
from evidara.plans.registry import query, table


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def orphans_left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.orphans(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings"), "doc_id", "vec_id")


_INPUTS = "SELECT doc_id AS chunk_id, sha256(text) AS embedding_input_sha256 FROM documents"
_HAVE = "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 9 = 0 THEN 'stale' ELSE sha256(text) END AS input_sha256, CASE WHEN vec_id % 11 = 0 THEN 'p2' ELSE 'p1' END AS profile_id FROM embeddings JOIN documents ON vec_id = doc_id"


def _have(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    j = e.join(d, F.col("vec_id") == F.col("doc_id"))
    return j.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 9 == 0, "stale").otherwise(F.sha2("text", 256)).alias("input_sha256"), F.when(F.col("vec_id") % 11 == 0, "p2").otherwise("p1").alias("profile_id"))


@query(f"SELECT c.chunk_id FROM ({_INPUTS}) c WHERE NOT EXISTS (SELECT 1 FROM ({_HAVE}) h WHERE h.profile_id = 'p1' AND h.chunk_id = c.chunk_id AND h.input_sha256 = c.embedding_input_sha256)")
def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("embedding_input_sha256"))
    return index.missing_embeddings(inputs, _have(spark, sf_dir), "p1").select("chunk_id")


@query("SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS labelled FROM documents d")
def exists_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(have, "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


# Chunks of a document: windows of 400 characters every 300; passages: 80 characters from a third of it.
_WINDOWS = "SELECT doc_id, k AS chunk, k * 300 AS char_start, k * 300 + 400 AS char_end FROM (SELECT doc_id, unnest(range(0, greatest(1, length(text) // 300))) AS k FROM documents)"
_PASSAGES = "SELECT doc_id, length(text) // 3 AS p_start, length(text) // 3 + 80 AS p_end FROM documents"


@query(f"SELECT w.doc_id, w.chunk::INTEGER AS chunk, (char_end - char_start)::INTEGER AS width FROM ({_WINDOWS}) w JOIN ({_PASSAGES}) p ON w.doc_id = p.doc_id AND char_start <= p_start AND char_end >= p_end")
def containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.floor(F.length("text") / 300)).cast("int") - 1))
    keys = [F.col("doc_id").alias("document_id"), F.lit("v").alias("version_id"), F.lit("s").alias("section_id")]
    chunks = d.select(*keys, k.alias("chunk")).select("*", (F.col("chunk") * 300).alias("char_start"), (F.col("chunk") * 300 + 400).alias("char_end"), F.lit(None).cast("string").alias("table_id"))
    start = F.floor(F.length("text") / 3).cast("int")
    passages = d.select(*keys, start.alias("char_start"), (start + 80).alias("char_end"), F.lit(None).cast("string").alias("table_id"))
    return evaluate.containing(chunks, passages).select(F.col("document_id").alias("doc_id"), "chunk", (F.col("char_end") - F.col("char_start")).alias("width"))


_VALID = "SELECT c_custkey, DATE '1992-01-01' + (c_custkey % 1000)::INTEGER AS valid_from, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '1992-01-01' + (c_custkey % 1000)::INTEGER + 1200 END AS valid_to FROM customer"


@query(f"SELECT o_orderkey FROM orders JOIN ({_VALID}) v ON o_custkey = c_custkey WHERE valid_from <= o_orderdate::DATE AND (valid_to IS NULL OR o_orderdate::DATE <= valid_to)")
def asof_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (F.col("c_custkey") % 1000).cast("int")
    start = F.date_add(F.lit("1992-01-01").cast("date"), days)
    valid = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), start.alias("valid_from"), F.when(F.col("c_custkey") % 3 != 0, F.date_add(start, 1200)).alias("valid_to"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return evaluate.as_of(orders, valid, ["o_custkey"], "day").select("o_orderkey")


_LINES = "SELECT doc_id, unnest(list_transform(range(1, len(l) + 1), lambda i: {'row': i, 'a': list_sum([0] || list_transform(l[1:i - 1], lambda x: length(x) + 1)), 'n': length(l[i])}), recursive := true) FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(f"SELECT doc_id, min(row)::INTEGER AS row_start, max(row)::INTEGER AS row_end FROM ({_LINES}) WHERE a < 500 AND a + n > 100 GROUP BY doc_id")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document that overlap its characters 100 to 500: a running cursor and two array bounds, no join."""
    lines = F.split("text", "\n")
    ends = F.aggregate(
        lines,
        F.expr("cast(array() as array<struct<a:int,b:int>>)"),
        lambda acc, x: F.concat(acc, F.array(F.struct((F.coalesce(F.try_element_at(acc, F.lit(-1))["b"] + 1, F.lit(0))).alias("a"), (F.coalesce(F.try_element_at(acc, F.lit(-1))["b"] + 1, F.lit(0)) + F.length(x)).alias("b")))),
    )
    df = table(spark, sf_dir, "documents").select("doc_id", F.get(F.array(ends), F.lit(0)).alias("rows"))
    hit = F.filter(F.transform("rows", lambda r, k: F.struct((k + 1).alias("row"), r["a"].alias("a"), r["b"].alias("b"))), lambda r: (r["a"] < 500) & (r["b"] > 100))
    touched = df.select("doc_id", F.transform(hit, lambda r: r["row"]).alias("t")).where(F.size("t") > 0)
    return touched.select("doc_id", F.array_min("t").alias("row_start"), F.array_max("t").alias("row_end"))


@query("SELECT coalesce(d.doc_id, e.vec_id) AS doc_id, CASE WHEN e.vec_id IS NULL THEN 'left' ELSE 'right' END AS side FROM documents d FULL JOIN (SELECT vec_id + 100 AS vec_id FROM embeddings) e ON d.doc_id = e.vec_id WHERE d.doc_id IS NULL OR e.vec_id IS NULL")
def full_outer_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.key_differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 100).alias("doc_id")), "doc_id")


@query("SELECT event_id FROM events WHERE event_type = 'error' AND json_extract_string(props, '$.k')::INTEGER % 2 = 0")
def sub_map_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose attributes have all expected keys at their values."""
    actual = F.create_map(F.lit("type"), F.col("event_type"), F.lit("even"), (F.get_json_object("props", "$.k").cast("int") % 2 == 0).cast("string"), F.lit("user"), F.col("user_id").cast("string"))
    expected = F.create_map(F.lit("type"), F.lit("error"), F.lit("even"), F.lit("true"))
    return table(spark, sf_dir, "events").where(evaluate.sub_map(expected, actual)).select("event_id")


@query("SELECT n_name, count(*)::BIGINT AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 8 = 0) o ON o_custkey = c_custkey WHERE o_orderkey IS NULL GROUP BY n_name")
def dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders of one class by nation: an anti join and a dimension."""
    idle = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderkey % 8 = 0"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return idle.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT count(*)::BIGINT AS pairs, count(*) FILTER (a.event_type = b.event_type)::BIGINT AS agree FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows joined with the rows at the next ordinal."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    n = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("next"))
    return e.join(n, "event_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("event_type") == F.col("next")).alias("agree"))


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1 AND toxic = 0)")
def coverage_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select("doc_id")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def reference_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stand in a document: a document that holds an item has the item's longest inner word as a word of its own.

    That word is the key of the join; items without one are compared with every document.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    inner = F.filter(F.slice(F.split(low, r"\s+"), F.lit(2), F.greatest(F.size(F.split(low, r"\s+")) - 2, F.lit(0))), lambda w: w != "")
    longest = F.reduce(inner, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    items = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", low.alias("item"), longest.alias("word"))
    docs = table(spark, sf_dir, "documents").select("doc_id", low.alias("low"))
    keyed = docs.select("doc_id", "low", F.explode(F.array_distinct(F.split("low", r"\s+"))).alias("word")).join(items.where("word <> ''"), "word")
    bare = docs.join(items.where("word = ''"), F.col("low").contains(F.col("item")))
    return keyed.where(F.col("low").contains(F.col("item"))).select("item_id", "doc_id").unionByName(bare.select("item_id", "doc_id"))


@query("SELECT o_custkey AS custkey, max_by(o_orderstatus, o_orderkey) AS status, max_by(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of every key in an append-only ledger."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    return index.latest(o, "custkey", "o_orderkey", ["status", "price"])


_NEW = "SELECT doc_id + 200 AS doc_id, upper(lang) AS lang, CASE WHEN doc_id % 4 = 0 THEN 'changed' ELSE source END AS source FROM documents WHERE doc_id % 2 = 0"


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    return d.select((F.col("doc_id") + 200).alias("doc_id"), F.upper("lang").alias("lang"), F.when(F.col("doc_id") % 4 == 0, "changed").otherwise(F.col("source")).alias("source"))


@query(f"WITH n AS ({_NEW}) SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.upserted(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), _new(spark, sf_dir), "doc_id")


@query(f"WITH n AS ({_NEW}), f AS (SELECT n.* FROM n LEFT JOIN documents d USING (doc_id) WHERE d.source IS DISTINCT FROM n.source) SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f) UNION ALL SELECT * FROM f")
def conditional_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows whose source differs are replaced."""
    return index.upserted(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), _new(spark, sf_dir), "doc_id", "source")


@query("SELECT (SELECT count(*) FROM labels)::BIGINT AS staged, 0 AS expected, count(*) FILTER (d.doc_id IS NULL)::BIGINT AS orphans, (SELECT count(*) FROM labels) = 0 AND count(*) FILTER (d.doc_id IS NULL) = 0 AS valid FROM labels l LEFT JOIN documents d USING (doc_id)")
def stage_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.reconciled(table(spark, sf_dir, "labels").select("doc_id"), 0, table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT sha256(text) AS content_sha256, min(doc_id) AS first_id, count(*)::BIGINT AS copies FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return hashed.groupBy("content_sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def _digest_sql(by: str) -> str:
    return f"""
WITH r AS (SELECT {by} substr(sha256(doc_id::VARCHAR), 1, {index.BUCKET_DIGITS}) AS b, doc_id::VARCHAR AS o, sha256(doc_id || chr(31) || text || chr(31) || lang || chr(31) || source) AS h FROM documents),
p AS (SELECT {by} b, count(*) AS n, sha256(string_agg(h, '' ORDER BY o, h)) AS d FROM r GROUP BY {by} b)
SELECT {by} sum(n)::BIGINT AS rows, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM p {"GROUP BY " + by.rstrip(", ") if by else ""}"""


@query(_digest_sql("source, "))
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each shard."""
    return index.table_digest(table(spark, sf_dir, "documents"), "doc_id", ["doc_id", "text", "lang", "source"], ["source"])


@query(_digest_sql(""))
def corpus_table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of the whole table, by buckets; no task sees more than one."""
    return index.table_digest(table(spark, sf_dir, "documents"), "doc_id", ["doc_id", "text", "lang", "source"])


@query("SELECT lang, min_by(doc_id, sha256('seed' || doc_id::VARCHAR)) AS doc_id FROM documents GROUP BY lang")
def argmin_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.min_by("doc_id", F.sha2(F.concat(F.lit("seed"), F.col("doc_id").cast("string")), 256)).alias("doc_id"))


@query("SELECT doc_id, rank::INTEGER AS rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed' || doc_id::VARCHAR)) AS rank FROM documents) WHERE rank <= 25")
def hash_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 25 documents of each language in the order of a hash."""
    from evidara.operators.retrieve import top

    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return top(d, ["lang"], [F.sha2(F.concat(F.lit("seed"), F.col("doc_id").cast("string")), 256)], 25).select("doc_id", "rank")


@query("""
WITH o AS (SELECT doc_id, lang, sha256(text) AS k, sha256('seed' || doc_id::VARCHAR) AS h FROM documents),
a AS (SELECT doc_id, lang, k, row_number() OVER (ORDER BY h) AS taken FROM (SELECT * FROM o WHERE lang = 'en' QUALIFY row_number() OVER (PARTITION BY k ORDER BY h) = 1) QUALIFY taken <= 40),
b AS (SELECT doc_id, lang, k, row_number() OVER (ORDER BY h) AS taken FROM (SELECT * FROM o WHERE lang = 'fr' AND k NOT IN (SELECT k FROM a) QUALIFY row_number() OVER (PARTITION BY k ORDER BY h) = 1) QUALIFY taken <= 20),
c AS (SELECT doc_id, lang, k, row_number() OVER (ORDER BY h) AS taken FROM (SELECT * FROM o WHERE lang = 'de' AND k NOT IN (SELECT k FROM a UNION SELECT k FROM b) QUALIFY row_number() OVER (PARTITION BY k ORDER BY h) = 1) QUALIFY taken <= 10)
SELECT doc_id, lang, taken::INTEGER AS taken FROM (FROM a UNION ALL FROM b UNION ALL FROM c)""")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("k"))
    order = [F.sha2(F.concat(F.lit("seed"), F.col("doc_id").cast("string")), 256)]
    return evaluate.quota_sample(d, "lang", order, ["k"], {"en": 40, "fr": 20, "de": 10}).select("doc_id", "lang", "taken")


@query("SELECT doc_id FROM documents QUALIFY list_contains(list_transform(range(128), lambda i: round_even(i * (count(*) OVER () - 1) / 127, 0)::BIGINT), row_number() OVER (ORDER BY doc_id) - 1)")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidara.operators.corpus import even_sample as sample

    return sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 128).select("doc_id")


@query("SELECT 'langs' AS fixture, 'it' AS missing, 'es' AS unknown")
def coverage_set_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults = evaluate.set_faults("langs", table(spark, sf_dir, "documents"), ["en", "fr", "de", "it"], "lang")
    return faults.select("fixture", F.array_join("missing", ",").alias("missing"), F.array_join("unknown", ",").alias("unknown"))
