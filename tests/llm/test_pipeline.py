from __future__ import annotations

import random
from pathlib import Path

import pytest

import corpus_pipeline as C


def write(spark, tmp_path: Path, docs, bench):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_every_stage_decides(spark, docs, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "ter", "ol", "mi", "ra", "ke"]) for _ in range(rng.randrange(1, 5)))
    line = lambda n: " ".join(word() for _ in range(n))
    item, footer = line(30), "this footer stands in many documents"
    texts = [line(40) + "\n" + line(30) for _ in range(30)]
    texts += ["12345 !!", None, texts[0], texts[1].upper(), line(20) + " " + item + " " + line(9), *(line(30) + "\n" + footer for _ in range(4))]
    sf = write(spark, tmp_path, docs(texts), [(1, item)])
    source = spark.read.parquet(sf + "/documents.parquet")
    seen, df = [], source
    for name, stage in C.STAGES:
        df = stage(spark, df, sf)
        out = f"{sf}/out-{name}"
        df.write.parquet(out)
        df = spark.read.parquet(out)
        if name != "bpe":
            assert df.dtypes == source.dtypes
        seen.append({r.doc_id for r in df.select("doc_id").collect()})
    every = set(range(1, len(texts) + 1))
    assert seen[0] == every - {31, 32} and seen[1] == seen[0]
    assert seen[2] == seen[1] - {33, 34} and seen[3] == seen[2] - {35} == seen[4]
    lines = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/out-line_dedup").collect()}
    assert [footer in lines[k] for k in (36, 37, 38, 39)] == [False, False, False, True]
    whole = sorted(map(tuple, C.run(spark, sf).collect()))
    assert whole == sorted(map(tuple, df.collect()))


def test_empty_tables(spark, docs, tmp_path):
    sf = write(spark, tmp_path, docs([]).where("doc_id < 0"), [])
    assert C.run(spark, sf).collect() == []


def test_a_later_run_goes_on_after_the_last_finished_stage(spark, docs, tmp_path, monkeypatch):
    sf = write(spark, tmp_path, docs(["the cat sat on the mat", "a dog ran over the road"]), [(1, "words that no document here has got")])
    out = str(tmp_path / "stages")

    def fail(*_):
        raise RuntimeError("lost")

    whole = C.STAGES
    monkeypatch.setattr(C, "STAGES", [*whole[:2], ("simhash", fail), *whole[3:]])
    with pytest.raises(RuntimeError):
        C.run(spark, sf, out)
    monkeypatch.setattr(C, "STAGES", [("language_id", fail), ("line_dedup", fail), *whole[2:]])
    assert sorted(r.doc_id for r in C.run(spark, sf, out).collect()) == [1, 2]


def test_a_failed_run_leaves_nothing(spark, docs, tmp_path, monkeypatch):
    sf = write(spark, tmp_path, docs(["the cat sat on the mat"]), [(1, "words that no document here has got")])
    folder = tmp_path / "shared"
    monkeypatch.setattr(C, "shared_folder", lambda spark: str(folder))
    monkeypatch.setattr(C, "STAGES", [C.STAGES[0], ("line_dedup", lambda *_: 1 / 0)])
    with pytest.raises(ZeroDivisionError):
        C.run(spark, sf)
    assert not any(folder.iterdir())


def test_clashing_columns_and_repeated_rows(spark, docs, tmp_path):
    rng = random.Random(11)
    a, b = (" ".join(rng.choice(["an", "ter", "ol", "mi", "ra", "ke"]) + rng.choice("abcdef") for _ in range(60)) for _ in range(2))
    names = ["n_lines", "n_dropped", "kept_sha256", "item_id", "node", "held_out", "lang_pred", "score", "own", "least", "n_tokens"]
    df = docs([(1, a), (1, a), (None, a), (2, b), (None, b), (3, None), (None, None), (4, "")]).selectExpr("*", *(f"{k} as `{n}`" for k, n in enumerate(names)))
    sf = write(spark, tmp_path, df, [(1, "words that no document here has got")])
    assert [r.doc_id for r in C.run(spark, sf).orderBy("doc_id").collect()] == [1, 2]
