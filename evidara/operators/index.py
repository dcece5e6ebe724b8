"""Indexes as tables: identifiers, postings, vectors; incremental upserts and audits of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions.text import normal_identifier


def identifier_rows(chunks: DataFrame) -> DataFrame:
    """(normalized_identifier, identifier_type, chunk_id), each once: one pass that explodes up to five identifiers per active chunk."""
    title = F.regexp_extract("contextual_header", r"\[DOCUMENT: ([^\]]+)\]", 1)
    alias = F.when(F.col("section_id").contains("#"), F.split_part("section_id", F.lit("#"), F.lit(2)))
    named = [("document_id", F.col("document_id")), ("document_title", title), ("citation", F.col("canonical_reference_id")), ("section", F.col("section_id")), ("section", alias)]
    rows = F.array(*(F.struct(normal_identifier(v.cast("string")).alias("normalized_identifier"), F.lit(k).alias("identifier_type"), F.nullif(v.cast("string"), F.lit("")).alias("given")) for k, v in named))
    found = chunks.where("is_active").select("chunk_id", F.explode(rows).alias("i")).where("i.given is not null")
    return found.select("i.normalized_identifier", "i.identifier_type", "chunk_id").distinct()


def postings(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(term, key, tf): counted within each row before anything is shuffled."""
    return docs.select(key, F.explode(terms).alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"))


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, profile: str) -> DataFrame:
    """Chunks without a vector of the same input under a profile."""
    have = embeddings.where(F.col("profile_id") == profile).select("chunk_id", F.col("input_sha256").alias("embedding_input_sha256"))
    return chunks.join(have, ["chunk_id", "embedding_input_sha256"], "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: str, changed: str | None = None) -> DataFrame:
    """Rows of old with those of new in their place or added; with `changed`, only where that column differs.

    Parquet has no MERGE: rows that stay are an anti join, written beside the old version.
    """
    if changed is None:
        return old.join(new, key, "left_anti").unionByName(new)
    same = old.select(key, F.col(changed).alias("_was"))
    fresh = new.join(same, key, "left").where(~F.col(changed).eqNullSafe(F.col("_was")) | F.col("_was").isNull()).drop("_was")
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def replaced_distinct(*projections: DataFrame) -> DataFrame:
    """The union of several projections, each row once: what a truncate and insert leaves."""
    out = projections[0]
    for p in projections[1:]:
        out = out.unionByName(p)
    return out.distinct()


def latest(ledger: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last state of every key in an append-only ledger."""
    return ledger.groupBy(key).agg(*(F.max_by(c, order).alias(c) for c in columns))


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def reconciled(staged: DataFrame, expected: int, target: DataFrame, key: str) -> DataFrame:
    """One row: staged count, expected count, orphans, and whether the swap may go on."""
    counts = staged.agg(F.count(F.lit(1)).alias("staged"))
    lost = orphans(staged, target, key, key).agg(F.count(F.lit(1)).alias("orphans"))
    both = counts.join(F.broadcast(lost), F.lit(True))  # one row each
    return both.select("staged", F.lit(expected).alias("expected"), "orphans", ((F.col("staged") == expected) & (F.col("orphans") == 0)).alias("valid"))


#: Hex digits of a hash that name a bucket of a digest: 65,536 buckets.
BUCKET_DIGITS = 4


def table_digest(df: DataFrame, order: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, rows, digest) of a table or of each of its groups: SHA-256 of ordered rows within hash buckets, then of the buckets' digests in order.

    The order is total within a bucket and the buckets are named, so a digest depends on the rows
    alone; no task sees more than a bucket of rows.
    """
    by = by or []
    line = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in columns))
    key = F.col(order).cast("string")
    rows = df.select(*by, F.substring(F.sha2(key, 256), 1, BUCKET_DIGITS).alias("b"), F.struct(key.alias("o"), F.sha2(line, 256).alias("h")).alias("r"))
    parts = rows.groupBy(*by, "b").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["h"]), ""), 256).alias("d"))
    return parts.groupBy(*by).agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda r: r["d"]), ""), 256).alias("digest"))
