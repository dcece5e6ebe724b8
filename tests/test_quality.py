from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidara.operators import candidates as C
from evidara.operators import evaluate, providers
from evidara.streaming import stateful


def test_classes_periods_and_years(spark):
    rows = [
        ("court_decision", "A v B [2019] HCA 1", None, "current", None, None, True), ("court_decision", "A v B", None, "current", None, None, False), ("public_ruling", "R", "TR 2020/1", "current", None, None, True),
        ("public_ruling", "R", "TD 2020/1", "current", None, None, False), ("public_ruling", "R", "TR 2020/1", "withdrawn", None, None, False), ("ato_public_guidance", "G", "TR 2020/1", None, None, None, False), ("ato_public_guidance", "G", None, None, None, None, True),
        ("commonwealth_statute", "Income Tax Assessment Act 1997", None, None, "https://www.legislation.gov.au/x", "C1", True), ("commonwealth_statute", "Other Act 1997", None, None, "https://www.legislation.gov.au/x", "C1", False), ("blog", "x", None, None, None, None, False),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, c string, t string, r string, s string, u string, g string, want boolean")
    got = df.select("k", "want", C.class_is_consistent(*map(F.col, "ctrsug")).alias("ok")).collect()
    assert all(r.ok == r.want for r in got)
    d = spark.createDataFrame([(["2019-20", "2021-22", "x"], False, {"issued": "1 May 2020"}, "TR 2021/3"), (["2010-11"], False, {"issued": "2020"}, None), (["2010-11"], True, {"issued": "2020"}, "TR 93/1"), (["none"], None, {}, None)], "p array<string>, h boolean, d map<string,string>, r string")
    y = C.issue_year(F.col("d"), F.col("r"))
    out = d.select(y.alias("y"), C.operative_period(F.col("p"), F.col("h"), y).alias("p")).collect()
    assert [(r.y, r.p) for r in out] == [(2021, "2021-22"), (2020, None), (2020, "2010-11"), (None, None)]
    t = spark.createDataFrame([("2020-21", "in 2021 and 2019"), ("2020-21", "by 2022"), (None, "by 2050")], "p string, x string")
    assert [(r[0], str(r[1])) for r in t.select(C.temporal_is_consistent(F.col("p"), F.col("x")), C.applicable_as_of(F.col("p"))).collect()] == [(True, "2021-06-30"), (False, "2021-06-30"), (True, "None")]


def test_governance_and_fixtures(spark):
    df = spark.createDataFrame([("A", "lead", "2026-01-02", "approved", "h", "h"), (" ", "x", "2 May", "rejected", "h", "g")], "a string, r string, d string, s string, h string, e string")
    assert [len(r[0]) for r in df.select(C.approval_faults(*map(F.col, "ardshe"), ["lead"])).collect()] == [0, 5]
    fx = spark.createDataFrame([("f1", "m", "p", "h"), ("f2", "m", "q", "h"), ("f3", "z", "p", "h"), ("f4", "m", "p", "other")], "fixture_id string, source_manifest string, relative_path string, file_sha256 string")
    inv = spark.createDataFrame([("m", "p", "h")], "source_manifest string, relative_path string, file_sha256 string")
    assert {r.fixture_id: r.fault for r in C.fixture_faults(fx, inv, ["m"]).collect()} == {"f1": None, "f2": "not_indexed", "f3": "unknown_manifest", "f4": "hash_mismatch"}
    audit = spark.createDataFrame([(3, 0, 2)], "a int, b int, c int")
    assert {(r.blocker, r.n) for r in C.import_blockers(audit, ["a", "b", "c"]).collect()} == {("a", 3), ("c", 2)}
    t = C.templated([(F.col("a") > 5, F.lit("big")), (F.col("a") > 2, F.lit("mid"))], F.lit("small"))
    assert audit.select(t).first()[0] == "mid"


def test_providers_are_checked_and_retried(spark):
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("down")
        return "ok"

    assert providers.with_retries(flaky, first=2, longest=5, sleep=waits.append) == "ok" and waits == [2, 4, 5]
    with pytest.raises(OSError):
        providers.with_retries(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)
    embed = providers.local_embedding(8)
    v, n = embed(["a b", "c"])
    assert n == 3 and providers.checked_vectors(["a b", "c"], v, n, 8)
    for texts, vectors, tokens, dim in ((["a"], v, n, 8), (["a", " "], v, n, 8), (["a", "b"], v, n, 9), (["a", "b"], [[float("nan")] * 8] * 2, n, 8), (["a", "b"], v, -1, 8), ([], [], 0, 8)):
        with pytest.raises(providers.ProviderError):
            providers.checked_vectors(texts, vectors, tokens, dim)
    for scores in ([(0, 0.5)], [(0, 0.5), (0, 0.4)], [(0, 0.5), (5, 0.4)], [(0, 1.5), (1, 0.4)]):
        with pytest.raises(providers.ProviderError):
            providers.checked_scores(3, 2, scores)
    assert [len(b) for b in providers.micro_batches(list(range(300)))] == [128, 128, 44]
    with pytest.raises(ValueError):
        providers.micro_batches([1], 129)


def test_embedding_runs_resume(spark):
    rows = [(k, f"text {k}", F"h{k}") for k in range(30)]
    import hashlib

    chunks = spark.createDataFrame([(k, t, hashlib.sha256(t.encode()).hexdigest()) for k, t, _ in rows], "chunk_id bigint, text string, embedding_input_sha256 string")
    none = spark.createDataFrame([], "chunk_id bigint, profile_id string, embedding array<float>, input_sha256 string")
    embed = providers.local_embedding(8)
    new, ledger = providers.embedding_run(chunks, none, "p", embed, 8)
    assert new.count() == 30 and ledger["status"] == "complete" and ledger["inputs"] == 30
    have = new.where("chunk_id < 20")
    more, ledger = providers.embedding_run(chunks, have, "p", embed, 8)
    assert more.count() == 10 and providers.embedding_run(chunks, have.unionByName(more), "p", embed, 8)[1]["inputs"] == 0
    assert providers.embedding_run(chunks, none, "p", embed, 8, ceiling=3)[1]["status"] == "budget_stopped"
    got = providers.provider_reranked(spark.createDataFrame([(1, "q", k, "x" * k) for k in range(1, 6)], "query_id bigint, query string, rank int, content string"), lambda q, c: sorted(((i, len(t) / 10) for i, t in enumerate(c)), key=lambda x: -x[1]), 3)
    assert [r["rank"] for r in got.orderBy("reranked").collect()] == [5, 4, 3]


def test_reports(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id int, chunk_id int, rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "query_id int, chunk_id int, rank int")
    assert {r.chunk_id: r.wins for r in evaluate.rank_changes(a, b, "chunk_id").collect()} == {7: False, 8: True, 9: True}


def test_streams_keep_state_between_batches(spark, tmp_path):
    for k, part in enumerate(([(1, 1, 0.0), (1, 2, 1.0)], [(1, 3, 2.0), (1, 4, 61.0), (2, 5, 2.0)])):
        spark.createDataFrame(part, "user_id bigint, event_id bigint, at double").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/batch={k}"))
    schema = "user_id bigint, event_id bigint, at double, batch int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.admitted_stream(stream.drop("batch"), "user_id", 2, 60.0)
    q = out.writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event_id: r.admitted for r in spark.table("admitted").collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}
    stateful.merged_batches(stream.select("user_id", "event_id", "at"), str(tmp_path / "c2"), stateful.ledger_merge(str(tmp_path / "ledger"), "user_id")).stop()
    led = spark.read.parquet(str(tmp_path / "ledger"))
    assert led.groupBy("user_id").agg(F.max("event_id").alias("e")).orderBy("user_id").collect()[0].e == 4


def test_a_run_that_stops_or_fails_goes_on_where_it_was(spark, tmp_path):
    from evidara.operators import providers as P

    rows = [(k, f"text number {k} " * (k % 4 + 1)) for k in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, text string").withColumn("embedding_input_sha256", F.sha2("text", 256))
    local = P.local_embedding(8)
    whole = P.resumable_run(chunks, str(tmp_path / "one"), "p", local, 8, rows=10)
    assert whole == {"profile_id": "p", "status": "complete", "commits": 6, "embedded": 60, "corpus_tokens": sum(len(t.split()) for _, t in rows)}

    folder = str(tmp_path / "many")
    assert P.resumable_run(chunks, folder, "p", local, 8, rows=10, most=1)["status"] == "paused"
    stopped = P.resumable_run(chunks, folder, "p", local, 8, ceiling=1, rows=10)
    assert (stopped["status"], stopped["commits"]) == ("budget_stopped", 0)

    def broken(texts):
        if any("number 59" in t for t in texts):
            raise ValueError("no service")
        return local(texts)

    with pytest.raises(Exception, match="no service"):
        P.resumable_run(chunks, folder, "p", broken, 8, rows=10)
    held = P.committed(spark, folder).count()
    assert 0 < held < 60
    rest = P.resumable_run(chunks, folder, "p", local, 8, rows=10)
    assert rest["embedded"] == 60 - held and rest["corpus_tokens"] == whole["corpus_tokens"]
    key = lambda f: sorted((r.chunk_id, r.input_sha256, tuple(r.embedding)) for r in P.committed(spark, f).collect())
    assert key(folder) == key(str(tmp_path / "one"))
    assert P.resumable_run(chunks.withColumn("embedding_input_sha256", F.lit("changed")).where("chunk_id < 3"), folder, "p", local, 8)["embedded"] == 3
