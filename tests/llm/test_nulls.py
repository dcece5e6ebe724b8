from __future__ import annotations

import pytest

import corpus_pipeline
from evidara.llm import queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "long text that goes on and on without any end in sight " * 4_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with nulls in every column, repeated rows and a very long text."""
    d = tmp_path_factory.mktemp("nulls")
    line = "the very same line stands in all of these documents"
    rows = [(None, None, None, None, None), (None, line + "\nx", "en", None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, line, None, None, None), (3, line, None, None, None), (4, line + " \n" + LONG, "en", "s", 9), (5, LONG, "fr", None, None), (6, "1 2 3", "en", "s", 5)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(None, None), (1, None), (None, line), (2, line)], "item_id bigint, text string").write.parquet(str(d / "benchmark.parquet"))
    spark.createDataFrame([(None, None, None), (1, None, "<p>"), (2, "http://a.org/x", None), (2, "http://a.org/x", None)], "page_id bigint, url string, html string").write.parquet(str(d / "pages.parquet"))
    vectors = [(None, [1.0, 0.0], 1), (0, None, 1), (50, [1.0, 0.5], 1), (50, [1.0, 0.5], 1), (51, [1.0, 0.4], 1), (52, [0.7, 0.4], 2), (53, [0.7, None], 2), (54, [float("nan"), 1.0], 2), (55, [0.7, 0.4], None), (57, [], 3)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(str(d / "embeddings.parquet"))
    return str(d)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_every_query_takes_nulls(spark, folder, name):
    rows = queries.queries()[name](spark, folder).collect()
    count = {"op4_decontaminate": None, "op5_url_filter": 4, "op6_packing": None, "op11_hard_negatives": 1, "op12_ranked_search": None}.get(name, 9)
    assert len(rows) == count if count is not None else rows
    if name == "op4_decontaminate":
        assert sorted((r.doc_id or 0, r.item_id) for r in rows) == [(0, 2), (3, 2), (3, 2), (4, 2)]
    if name == "op11_hard_negatives":
        assert [(r.anchor_id, r.positive_id, r.negative_id) for r in rows] == [(50, 51, 52)]
    if name == "op12_ranked_search":  # the rows without an id come last, the item without a text finds nothing
        assert {r.item_id for r in rows} == {None, 2} and [r.doc_id for r in sorted(rows, key=lambda r: r["rank"]) if r.item_id == 2] == [3, 3, None, 4, 5]
    if name == "op13_license_scan":
        assert all(r.n_base == 0 and r.first_word is None and r.labels == "" for r in rows)
    if name == "op6_packing":
        assert sorted(i or 0 for r in rows for i, at in zip(r.doc_ids, r.offsets) if at == 0) == [0, 0, 1, 2, 3, 3, 4, 5, 6]
    if name == "op3_line_dedup":
        assert sorted((r.doc_id or 0, r.n_dropped) for r in rows) == [(0, 0), (0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, 0), (5, 0), (6, 0)]


def test_the_pipeline_takes_nulls(spark, folder):
    # no letters: 1, 2, 6 and the null text; 4 keeps the common line, which is the benchmark's, and goes with it;
    # without that line the two rows of 3 are empty and one stays, the row without an id has "x" left
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in corpus_pipeline.run(spark, folder).collect()) == [(0, True), (3, False), (5, True)]
