"""The cleaning pipeline over documents.

Five stages, each judged on what its predecessor kept, written as Parquet and read again as
the next one's documents. All but the last return the columns of documents:

1. language_id: documents whose language cannot be told (no letter, or a mean marginal less than
   ``LEAST_MARGIN`` over the next language's) go;
2. line_dedup: repeated lines go from the texts;
3. simhash: of each component of near copies the row with the smallest doc_id stays, of rows that
   repeat doc_id and text any one. Two texts are linked by their SimHash fingerprints, as in operator 9
   (three-word shingles, 3 bits or fewer), or by a Jaccard similarity of their five-word shingles
   of 0.8 or more, which fingerprints alone would miss; both kinds are found exactly;
4. decontaminate: documents that hold a benchmark item go;
5. bpe: token counts and digests of the texts that are left.

Nulls: a null text has no language and goes in the first stage; a null doc_id is larger than all
others for copies and smaller for lines; nulls in other columns stay. Empty texts go like null ones.
Ties for a language go to the one that sorts first, ties among copies to the smaller doc_id. Very
long texts are judged whole. Repeated rows count as one document for lines, and as copies after
that. Other columns are carried to the last stage, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import bpe, decontaminate, langid, line_dedup, near_copies, simhash
from evidara.llm.common import lean_workers, path_exists, remove_folder, shared_folder, table

LEAST_MARGIN = 0.005


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told."""
    lean_workers(spark)
    return langid.keep_told(docs, LEAST_MARGIN)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document stays, be it empty then, and n_chars follows its text."""
    lean_workers(spark)
    return line_dedup.drop_repeated_lines(docs, report=False, count="n_chars")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, by fingerprints or by shingles, that of the smallest doc_id."""
    lean_workers(spark)
    return near_copies.without_near_copies(docs, also=simhash.rows_in_groups(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    lean_workers(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    lean_workers(spark)
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: Learned models, fingerprints and token merges are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage's rows over the documents of sf_dir.

    Stages are written under the shared folder, and what a stage has read goes when its own output is
    there; a run that fails leaves nothing. With a folder of the caller's own, all stages' outputs stay
    there, and a later run over the same tables goes on after the last one that was finished.
    """
    own = folder is None
    folder = folder or f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, last = table(spark, sf_dir, "documents"), None
    try:
        for k, (name, stage) in enumerate(STAGES):
            out = f"{folder}/{k}-{name}"
            if not path_exists(spark, f"{out}/_SUCCESS"):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
            docs = spark.read.parquet(out)
            if own and last:
                remove_folder(spark, last)
            last = out
    except BaseException:
        if own:
            remove_folder(spark, folder)
        raise
    return docs
