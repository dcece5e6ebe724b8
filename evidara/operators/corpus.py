"""Corpus registration: inventories, fingerprints, url conflicts, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_audit(index: DataFrame) -> DataFrame:
    """One row over index rows (path, relative_path, corpus): rows, unique and duplicate paths, legislation rows, rows without a path."""
    path = F.coalesce(F.col("path"), F.col("relative_path"))
    return index.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(path).alias("unique_paths"), (F.count(path) - F.count_distinct(path)).alias("duplicate_rows"),
        F.count_if(F.col("corpus") == "primary_legislation").alias("legislation_rows"), F.count_if(path.isNull()).alias("missing_paths"),
    )


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, n_bytes, file_sha256, body, valid) of binary files that hold one JSON document each."""
    text = F.decode("content", "UTF-8")
    return files.select("path", F.length("content").cast("bigint").alias("n_bytes"), F.sha2("content", 256).alias("file_sha256"), text.alias("body"), F.try_parse_json(text).isNotNull().alias("valid"))


def inventory(files: DataFrame, schema_version: str) -> tuple[DataFrame, DataFrame]:
    """(inventory, audit): rows with document and version ids, and counts of what forbids publication."""
    v = F.try_parse_json("body")
    get = lambda p: F.try_variant_get(v, p, "string")
    rows = fingerprints(files).select("path", "n_bytes", "file_sha256", "valid", get("$.document_id").alias("document_id"), get("$.version.version_id").alias("version_id"), get("$.schema_version").alias("schema_version"))
    repeats = rows.where("document_id is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    again = repeats.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_document_ids"))
    audit = rows.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"), F.count_if(~F.col("valid")).alias("invalid_json"),
        F.count_if(F.col("valid") & ~F.col("schema_version").eqNullSafe(F.lit(schema_version))).alias("schema_mismatch"),
    )
    return rows, audit.join(F.broadcast(again), F.lit(True))  # one row each


def url_conflicts(identities: DataFrame) -> DataFrame:
    """(url, version_id, contents): versions of one canonical url with several contents; a null content is a content. identities: url, version_id, content_sha256."""
    per = identities.where("url <> ''").select("url", "version_id", "content_sha256").distinct()
    return per.groupBy("url", "version_id").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")


def url_groups(identities: DataFrame) -> DataFrame:
    """One row: canonical urls, rows without one, surplus rows, urls in conflict."""
    counts = identities.groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.count(F.lit(1)).alias("n"))
    summary = counts.agg(
        F.count_if(F.col("url") != "").alias("source_url_groups"),
        F.coalesce(F.sum(F.when(F.col("url") == "", F.col("n"))), F.lit(0)).alias("documents_without_source_url"),
        F.coalesce(F.sum(F.when(F.col("url") != "", F.col("n") - 1)), F.lit(0)).alias("duplicate_source_url_rows"),
    )
    bad = url_conflicts(identities).agg(F.count(F.lit(1)).alias("conflicting_source_urls"))
    return summary.join(F.broadcast(bad), F.lit(True))  # one row each


def located_once(manifests: DataFrame) -> DataFrame:
    """(document_id, locations) of ids at more than one location: must be empty before ids are resolved."""
    return manifests.groupBy("document_id").agg(F.count_distinct(F.struct("root", "path")).alias("locations")).where("locations > 1")


def even_sample(df: DataFrame, order: str, size: int) -> DataFrame:
    """Rows at round(i (n - 1) / (size - 1)), halves to even, of the order.

    The order's places come from counts per range partition, so no task holds more than its partition.
    """
    from evidara.operators.order import with_row_index

    ranked, total = with_row_index(df, order)
    if total <= size or size < 2:
        return ranked.where(F.col("row_index") < size)
    wanted = F.array(*(F.lit(round(i * (total - 1) / (size - 1))) for i in range(size)))
    return ranked.where(F.array_contains(wanted, F.col("row_index")))


def reverified(inventory_rows: DataFrame, files: DataFrame) -> DataFrame:
    """(path, fault) of inventory rows against the files as they are now: missing, changed, or another document; null where all holds."""
    v = F.try_parse_json("body")
    now = fingerprints(files).select("path", F.col("file_sha256").alias("now"), F.try_variant_get(v, "$.document_id", "string").alias("now_id"), F.try_variant_get(v, "$.version.version_id", "string").alias("now_version"))
    j = inventory_rows.join(now, "path", "left")
    same = F.col("document_id").eqNullSafe(F.col("now_id")) & F.col("version_id").eqNullSafe(F.col("now_version"))
    return j.select("path", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("file_sha256"), "changed").when(~same, "other_document").alias("fault"))


def active_children(children: DataFrame, report_is_valid: bool) -> DataFrame:
    """Active chunks with `fault` for ids that are not 64 characters or not the chunk's hash, and empty contents; refuses an export that did not pass its audit."""
    if report_is_valid is not True:
        raise ValueError("the export's verification report is not valid")
    fault = F.when(F.length("chunk_id") != 64, "bad_id").when(~F.col("chunk_hash").eqNullSafe(F.col("chunk_id")), "hash_mismatch").when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty_content")
    return children.where("is_active is true").withColumn("fault", fault)


def embedding_manifest(inputs: DataFrame, key: str, text: str, batch: int = 128) -> DataFrame:
    """One row: inputs, UTF-8 bytes, batches and an extrapolated number of tokens."""
    n = F.count(F.lit(1))
    return inputs.agg(n.alias("inputs"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint").alias("utf8_bytes"), F.ceil(n / batch).cast("bigint").alias("batches"), F.ceil(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) / 4).cast("bigint").alias("estimated_tokens"))


def catalog_rows(documents: DataFrame) -> DataFrame:
    """One flat row per document with defaults for what its classification leaves out."""
    get = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in documents.columns else F.lit(other)
    return documents.select(
        F.sha2(F.concat_ws("\x1f", "document_id", "version_id", F.lit("catalog")), 256).alias("catalog_id"), "document_id", "version_id", "title", "publisher", "source_url", "source_class",
        get("binding_effect", "none").alias("binding_effect"), get("authority_rank", 100).alias("authority_rank"), get("historical_guidance", False).alias("historical_guidance"), "canonical_reference_id",
    )


def metadata_faults(rows: DataFrame, needed: list[str], forbidden: list[str]) -> DataFrame:
    """(fault, n): needed columns that are null and forbidden columns that are there at all."""
    checks = [F.struct(F.lit(f"missing {c}").alias("fault"), (F.count_if(F.col(c).isNull()) if c in rows.columns else F.count(F.lit(1))).alias("n")) for c in needed]
    checks += [F.struct(F.lit(f"forbidden {c}").alias("fault"), F.count(F.lit(1)).alias("n")) for c in forbidden if c in rows.columns]
    return rows.agg(F.array(*checks).alias("f")).select(F.explode("f").alias("f")).select("f.*").where("n > 0")
