"""Reading and publishing tables: JSON lines, binary files, pinned files, versioned outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzip included, under a declared schema; blank lines are skipped and lines that do not parse are kept in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def json_lines_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As json_lines, and no rows where there is no such path."""
    from pyspark.errors import AnalysisException

    try:
        return json_lines(spark, path, schema)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, _corrupt string")


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, content) of whole files."""
    r = spark.read.format("binaryFile")
    return (r.option("pathGlobFilter", pattern) if pattern else r).load(path).select("path", "content")


def pinned(files_: DataFrame, manifest: DataFrame, most_bytes: int = 20 << 20) -> DataFrame:
    """Files (path, content) with `fault`: null only where the manifest's digest (path, sha256), size, suffix and magic bytes hold."""
    j = files_.join(manifest, "path", "left")
    magic = F.substring(F.hex(F.substring("content", 1, 5)), 1, 10)
    fault = (
        F.when(F.col("sha256").isNull(), "not_in_manifest")
        .when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "bad_digest")
        .when(F.length("content") > most_bytes, "too_large")
        .when(F.sha2("content", 256) != F.col("sha256"), "digest_mismatch")
        .when(F.col("path").contains("/../"), "outside_manifest")
        .when(F.lower("path").endswith(".pdf") & (magic != "255044462D"), "not_a_pdf")
        .when(F.lower("path").endswith(".docx") & ~magic.startswith("504B"), "not_a_docx")
        .when(~F.lower("path").rlike(r"\.(pdf|docx)$"), "unknown_suffix")
    )
    return j.withColumn("fault", fault)


def junit_totals(spark: SparkSession, path: str) -> DataFrame:
    """(tests, failures, errors, skipped) over all suites of JUnit reports."""
    kind = "_tests bigint, _failures bigint, _errors bigint, _skipped bigint"
    suites = spark.read.format("xml").option("rowTag", "testsuite").schema(kind).load(path)
    return suites.agg(*(F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(c) for c in ("tests", "failures", "errors", "skipped")))


def allowed_source(url: Column, hosts: list[str]) -> Column:
    """An https url of an allow-listed host."""
    return (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(hosts)


def publish_json(df: DataFrame, path: str, once: bool = True) -> None:
    """Gzip JSON lines; refuses an existing output unless told otherwise."""
    df.write.mode("errorifexists" if once else "overwrite").option("compression", "gzip").json(path)


def publish_sharded(df: DataFrame, path: str, shard: str, key: str, most: int | None = None, units: str | None = None) -> str:
    """Writes a new version under path, one folder per shard, after its guards hold: unique keys and nothing oversize. Returns the version's path."""
    repeats = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not repeats.isEmpty():
        raise ValueError(f"{key} is not unique")
    if most is not None and not df.where(F.col(units) > most).isEmpty():
        raise ValueError(f"a row has more than {most} {units}")
    out = f"{path}/version={uuid.uuid4().hex}"
    df.write.mode("errorifexists").partitionBy(shard).parquet(out)
    return out


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def snapshot(tables: dict[str, DataFrame], path: str, order: dict[str, str]) -> DataFrame:
    """Copies tables below path and returns their manifest (name, rows, digest)."""
    from evidara.operators.index import table_digest

    manifest = None
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
        row = table_digest(df, order[name], df.columns).select(F.lit(name).alias("name"), "rows", "digest")
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("errorifexists").json(f"{path}/manifest")
    return manifest


def verified(spark: SparkSession, path: str, order: dict[str, str]) -> DataFrame:
    """(name, ok) of a snapshot's tables against its manifest."""
    from evidara.operators.index import table_digest

    said = spark.read.schema("name string, rows bigint, digest string").json(f"{path}/manifest")
    now = None
    for name, key in order.items():
        df = spark.read.parquet(f"{path}/{name}")
        row = table_digest(df, key, df.columns).select(F.lit(name).alias("name"), F.col("rows").alias("rows_now"), F.col("digest").alias("digest_now"))
        now = row if now is None else now.unionByName(row)
    return said.join(now, "name", "left").select("name", (F.col("rows").eqNullSafe(F.col("rows_now")) & F.col("digest").eqNullSafe(F.col("digest_now"))).alias("ok"))


def review_sheet(cases: DataFrame, path: str) -> None:
    """A CSV row per case, header first."""
    cases.write.mode("errorifexists").option("header", True).csv(path)


def restored(spark: SparkSession, path: str, target: str, order: dict[str, str]) -> DataFrame:
    """Copies a snapshot into an empty target and checks the copies against the manifest."""
    bad = verified(spark, path, order).where("not ok")
    if not bad.isEmpty():
        raise ValueError("the snapshot does not match its manifest")
    for name in order:
        spark.read.parquet(f"{path}/{name}").write.mode("errorifexists").parquet(f"{target}/{name}")
    spark.read.schema("name string, rows bigint, digest string").json(f"{path}/manifest").write.mode("errorifexists").json(f"{target}/manifest")
    return verified(spark, target, order)


def manifest_lines(spark: SparkSession, path: str, sha256: str, schema: str) -> DataFrame:
    """JSON lines of one file whose digest must be the manifest's."""
    found = files(spark, path).select(F.sha2("content", 256).alias("h")).collect()  # one row per file of the path
    if [r.h for r in found] != [sha256]:
        raise ValueError("the inventory does not match its manifest")
    return json_lines(spark, path, schema)


def report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file, replaced as a whole: written beside, then swapped by the committer."""
    df.coalesce(1).write.mode("overwrite").json(path)
