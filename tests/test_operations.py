from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evidara.operators import corpus, court, index, telemetry
from evidara.sources import tables
from evidara.streaming import machines, windows


def test_paragraphs_open_only_in_order(spark):
    blocks = ["Intro", "[1] One two three four five.", "more of it here", "[9] far too high a number", "2 Second para has enough words.", "[2] again the same number", "3 few"]
    df = spark.createDataFrame([(blocks,), ([],)], "b array<string>").select(court.numbered_paragraphs(F.col("b")).alias("p"))
    got = [[(x.number, x.text) for x in r.p] for r in df.collect()]
    assert got == [[(1, "One two three four five. more of it here [9] far too high a number"), (2, "Second para has enough words. [2] again the same number")], []]


def test_court_pages(spark):
    html = "<title>Smith v Jones</title><nav><p>menu</p></nav><h1>Smith v Jones [2019] HCA 5</h1><p>Date of judgment: 3 March 2019</p><p>Brown CJ</p><script>p</script><p>[1] The appeal is about a tax.</p><p>unclosed <li>[2] It is dismissed with costs today.</li>"
    pages = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    b = court.pages_to_blocks(pages).withColumns({"source_url": F.lit("https://c/1"), "court": F.lit("High Court"), "citation": F.lit("[2019] HCA 5")})
    r = court.ready_documents(b).first()
    assert r.title == "Smith v Jones [2019] HCA 5" and r.decision_date == "2019-03-03" and r.judges == ["Brown CJ"]
    assert [s.section_id for s in r.sections] == ["para_1", "para_2"]
    assert court.ready_documents(b.withColumn("citation", F.lit("[2000] HCA 1"))).count() == 0


def test_limits_budgets_and_breakers(spark):
    calls = spark.createDataFrame([(1, k, float(t)) for k, t in enumerate([0, 1, 2, 61, 62, 200])], "user_id bigint, event_id bigint, at double")
    assert [r.admitted for r in machines.admissions(calls, "user_id", 2, 60.0).orderBy("event_id").collect()] == [True, True, False, True, True, True]
    costs = spark.createDataFrame([(1, k, float(k), c) for k, c in enumerate([60.0, 50.0, 40.0, 0.5])], "user_id bigint, event_id bigint, at double, cost double")
    assert [(r.accepted, r.spent) for r in machines.spending(costs, "user_id", 100.0).orderBy("event_id").collect()] == [(True, 60.0), (False, 60.0), (True, 100.0), (False, 100.0)]
    log = [(0, True), (1, True), (2, False), (31, False), (32, True), (33, False), (40, True), (41, True), (45, False), (80, True), (100, False), (111, False)]
    df = spark.createDataFrame([(1, k, float(t), f) for k, (t, f) in enumerate(log)], "user_id bigint, event_id bigint, at double, failed boolean")
    got = [(r.outcome, r.state) for r in machines.circuit_states(df, "user_id", 2, 30.0).orderBy("event_id").collect()]
    assert got[1:4] == [("failed", "OPEN"), ("rejected", "OPEN"), ("rejected", "OPEN")]
    assert got[4] == ("failed", "OPEN") and got[5][0] == "rejected"


def test_dead_letters(spark):
    log = spark.createDataFrame([(1, "a", "enqueued", "e1", 1), (2, "a", "failed", "e2", 2), (3, "b", "enqueued", "x", 3), (4, "a", "completed", "", 4)], "event_id int, job_id string, event string, error_message string, at int")
    got = {r.job_id: (r.status, r.error_message, r.retry_count) for r in machines.dead_letters(log).collect()}
    assert got == {"a": ("COMPLETED", "e2", 1), "b": ("FAILED", "x", 0)}
    assert [r.job_id for r in machines.replay_queue(machines.dead_letters(log)).collect()] == ["b"]


def test_streams_give_the_closed_windows_of_the_batch(spark, tmp_path):
    rows = [(k, f"2024-01-01 {k % 24:02d}:{k % 60:02d}:00", k % 5, "view", float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, f in (("tumbling", lambda d: windows.windowed(d, "1 hour")), ("sliding", lambda d: windows.windowed(d, "2 hours", "1 hour")), ("sessions", lambda d: windows.sessions(d, "30 minutes"))):
        windows.drained(f(stream), f"s_{name}", str(tmp_path / name)).stop()
        got, want = {tuple(map(str, r)) for r in spark.table(f"s_{name}").collect()}, {tuple(map(str, r)) for r in f(df).collect()}
        assert got <= want and len(got) >= 0.7 * len(want)
    windows.drained(windows.once_per_id(stream, "event_id"), "s_once", str(tmp_path / "once")).stop()
    assert spark.table("s_once").count() == 200


def test_upserts_and_digests(spark):
    old = spark.createDataFrame([(1, "a", "h1"), (2, "b", "h2")], "id int, v string, h string")
    new = spark.createDataFrame([(2, "B", "h2"), (3, "c", "h3")], "id int, v string, h string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(index.upserted(old, new, "id")) == [(1, "a", "h1"), (2, "B", "h2"), (3, "c", "h3")]
    assert rows(index.upserted(old, new, "id", "h")) == [(1, "a", "h1"), (2, "b", "h2"), (3, "c", "h3")]
    assert rows(index.replaced_distinct(old, old)) == rows(old)
    digest = lambda df: index.table_digest(df, "id", df.columns).first()
    assert digest(old) == digest(old.repartition(7)) != digest(new)


def test_files_and_publication(spark, tmp_path):
    docs = [{"document_id": "a", "schema_version": "1", "version": {"version_id": "v"}}, {"document_id": "a", "schema_version": "2"}]
    for k, d in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(d))
    (tmp_path / "bad.json").write_text("{")
    rows, audit = corpus.inventory(tables.files(spark, str(tmp_path), "*.json"), "1")
    a = audit.first()
    assert (a.files, a.invalid_json, a.schema_mismatch, a.duplicate_document_ids) == (3, 1, 1, 1) and rows.where("version_id = 'v'").count() == 1
    out = str(tmp_path / "out")
    tables.publish_json(spark.createDataFrame([(1, "x")], "id int, s string"), out)
    assert [tuple(r)[:2] for r in tables.json_lines(spark, out, "id int, s string").collect()] == [(1, "x")]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        tables.publish_json(spark.range(1), out)
    assert tables.json_lines_or_empty(spark, str(tmp_path / "nowhere"), "id int").count() == 0
    df = spark.createDataFrame([("s1", "a", 5), ("s2", "b", 9)], "shard string, id string, n int")
    assert spark.read.parquet(tables.publish_sharded(df, str(tmp_path / "sharded"), "shard", "id", 10, "n")).count() == 2
    for bad in (df.unionByName(df), df.withColumn("n", F.lit(11))):
        with pytest.raises(ValueError):
            tables.publish_sharded(bad, str(tmp_path / "sharded"), "shard", "id", 10, "n")


def test_snapshots_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "id int, v string")
    tables.snapshot({"t": df}, str(tmp_path / "snap"), {"t": "id"})
    assert tables.verified(spark, str(tmp_path / "snap"), {"t": "id"}).first().ok
    df.limit(1).write.mode("append").parquet(str(tmp_path / "snap/t"))
    assert not tables.verified(spark, str(tmp_path / "snap"), {"t": "id"}).first().ok
    (tmp_path / "j.xml").write_text('<testsuites><testsuite tests="3" failures="1" errors="0" skipped="1"/><testsuite tests="2" failures="0" errors="1" skipped="0"/></testsuites>')
    assert tuple(tables.junit_totals(spark, str(tmp_path / "j.xml")).first()) == (5, 1, 1, 1)
    pdf, sha = b"%PDF-1.7 x", "0" * 64
    files = spark.createDataFrame([("a.pdf", bytearray(pdf)), ("b.docx", bytearray(b"no")), ("c.pdf", bytearray(pdf))], "path string, content binary")
    import hashlib

    manifest = spark.createDataFrame([("a.pdf", hashlib.sha256(pdf).hexdigest()), ("b.docx", hashlib.sha256(b"no").hexdigest()), ("c.pdf", sha)], "path string, sha256 string")
    assert {r.path: r.fault for r in tables.pinned(files, manifest).collect()} == {"a.pdf": None, "b.docx": "not_a_docx", "c.pdf": "digest_mismatch"}


def test_span_trees(spark):
    t = "a" * 32
    spans = spark.createDataFrame([("1", None, t, "root", 0, 100), ("2", "1", t, "kid", 10, 50)], "span_id string, parent_span_id string, trace_id string, name string, start_ns bigint, end_ns bigint")
    obs = spark.createDataFrame([("o", "2", "m", 1.0)], "observation_id string, span_id string, model string, latency_ms double")
    whole = telemetry.with_model_spans(spans, obs)
    kid = whole.where("parent_span_id = '2'").first()
    assert (kid.start_ns, kid.end_ns) == (10, 50)
    assert {(r.depth, r.path) for r in telemetry.depths(whole).collect()} == {(0, "root"), (1, "root/kid"), (2, "root/kid/model.m")}
    assert len(json.loads(telemetry.encoded(whole).first().payload)["spans"]) == 3


def test_spans_of_any_depth(spark):
    rows = [("t", f"s{k}", f"s{k - 1}" if k else None, "n") for k in range(40)]
    got = telemetry.depths(spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, name string")).collect()
    assert sorted(r.depth for r in got) == list(range(40))


def test_payloads_carry_the_allowed_attributes(spark):
    import json

    rows = [("a" * 32, "s1", None, "root", 1, 2, {"version": "7", "secret": "x"}), ("a" * 32, "s2", "s1", "kid", 1, 2, None)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, name string, start_ns bigint, end_ns bigint, attributes map<string,string>")
    spans = {x["spanId"]: x["attributes"] for x in json.loads(telemetry.encoded(df).first().payload)["spans"]}
    assert spans == {"s1": [{"key": "version", "value": {"stringValue": "7"}}], "s2": []}


def test_quotas_are_filled_group_by_group(spark):
    from evidara.operators import evaluate

    take = lambda rows, quotas, keys=("k",): sorted(r.n for r in evaluate.quota_sample(spark.createDataFrame(rows, "n int, g string, k string, q string"), "g", [F.asc("n")], list(keys), quotas).collect())
    rows = [(1, "a", "k1", "q1"), (2, "a", "k2", "q2"), (3, "b", "k2", "q3"), (4, "z", "k3", "q4"), (5, "b", "k3", "q5")]
    assert take(rows, {"a": 1, "b": 2}) == [1, 3, 5]
    with pytest.raises(ValueError, match="b: 1 rows for a quota of 2"):
        take(rows, {"a": 2, "b": 2})
    # 2 shares a key with 1 and goes; it was not taken, so its other key blocks neither 3 nor 4
    assert take([(1, "a", "k1", "q1"), (2, "a", "k1", "q2"), (3, "a", "k3", "q2"), (4, "b", "k4", "q2"), (5, "b", "k3", "q9"), (6, "b", "k6", "q6")], {"a": 2, "b": 1}, ("k", "q")) == [1, 3, 6]


def test_blocks_of_pages_and_files():
    import io
    import zipfile

    from evidara.operators import court

    page = "<title>A &amp; B</title><nav><p>no</p></nav><p>one <b>two</b><li>three</li> lost</p><script>x</script><td></td><h1>four<p>five</p><p>open"
    assert court.html_blocks(page) == ("A & B", ["A & B", "three", "five"])
    assert court.html_blocks(None) == ("", [])
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {w}><w:body><w:p><w:r><w:t>a &amp; b</w:t><w:tab/><w:t>c</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>d</w:t></w:r></w:p></w:body></w:document>"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
    assert court.docx_blocks(raw.getvalue()) == ["a & b c", "d"]
