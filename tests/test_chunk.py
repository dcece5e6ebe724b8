from __future__ import annotations

import random
import re

import pytest

from evidara.operators import chunk as C

SMALL = C.Sizes(parent_target=40, parent_max=50, child_target=12, child_max=18, overlap=3)


def plain_spans(text, target, most, overlap):
    """The same rule by trying every end."""
    m = list(re.finditer(r"\w+(?:['’\-]\w+)*|[^\w\s]", text))
    out, at = [], 0
    while at < len(m):
        if len(m) - at <= most:
            end = len(m)
        else:
            good = []
            for e in range(at + max(1, target // 2), at + most + 1):
                gap = text[m[e - 1].end() : m[e].start()] if e < len(m) else ""
                if e == len(m) or m[e - 1].group() in ".!?;" or re.search(r"\n\s*\n", gap):
                    good.append(e)
            end = min(good, key=lambda e: abs(e - at - target)) if good else at + target
        out.append((m[at].start(), m[end - 1].end(), end - at))
        if end == len(m):
            break
        at = max(at + 1, end - overlap) if overlap else end
    return out


def test_spans_equal_the_plain_rule():
    rng = random.Random(1)
    for _ in range(120):
        text = "".join(rng.choice(["word ", "it's ", "x. ", "why? ", "a; ", "\n\n", "É ", "a-b "]) for _ in range(rng.randrange(0, 150)))
        for target, most, overlap in ((12, 18, 0), (12, 18, 3), (5, 5, 0), (40, 50, 0)):
            assert C.spans(text, target, most, overlap) == plain_spans(text, target, most, overlap)


def test_hard_cut_and_bounds():
    text = "word " * 5_000
    got = C.spans(text, 600, 900, 60)
    assert all(n <= 900 for *_, n in got) and got[0][2] == 600
    with pytest.raises(ValueError):
        C.Sizes(overlap=700)


def document(text, tables=None):
    return {"document_id": "d", "version_id": "v", "title": "T", "sections": [{"section_id": "s", "heading": "H", "heading_path": None, "text": text}], "tables": tables}


def test_offsets_are_exact_around_tables():
    text = "  First part here.\n| a | b |\n| 1 | 2 |\n\nSecond part, longer than the first. " + "More words here. " * 30 + "\n"
    rows = list(C.chunks(document(text), SMALL))
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] for r in rows)
    assert rows[0]["text"] == "First part here." and rows[0]["heading_path"] == ["H"]
    assert len({r["chunk_id"] for r in rows}) == len(rows) and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert not any("|" in r["text"] for r in rows)


def test_tables_become_labelled_lines():
    assert C.table_lines(["a", "b"], [["a", "b"], ["1", "2", "3"]]) == ["a: 1 | b: 2 | Column 3: 3"]
    assert C.table_lines([], [["h", ""], ["1", "2"]]) == ["h: 1 | Column 2: 2"]
    assert C.table_lines(["only", "heads"], []) == ["only | heads"] and C.table_lines(None, None) == []
    rows = list(C.chunks(document("", [{"table_id": None, "section_id": "s", "page_number": 2, "headers": ["k"], "matrix": [[f"value {k}"] for k in range(20)]}]), SMALL))
    assert rows[0]["row_start"] == 1 and rows[-1]["row_end"] == 20 and rows[0]["table_id"] == "table_0"


def test_rtf_is_skipped_and_numbering_is_deterministic(spark):
    assert list(C.chunks(document("{\\rtf1 x}"), SMALL)) == []
    docs = [{"document_id": f"d{k}", "version_id": "v", "title": "T", "sections": [{"section_id": "s", "heading": "H", "heading_path": ["P"], "text": f"Text {k}. " * (k % 40)}]} for k in range(60)]
    schema = "document_id string, version_id string, title string, sections array<struct<section_id:string,heading:string,heading_path:array<string>,text:string>>"
    df = spark.createDataFrame(docs, schema)
    seen = [sorted(r.chunk_id for r in C.chunked(df.repartition(n), SMALL).collect()) for n in (1, 3, 17)]
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0])) == len(seen[0]) > 60
    sections = df.selectExpr("document_id", "explode(sections) s").select("document_id", "s.section_id", "s.text")
    assert all(r.failures == 0 for r in C.audit(C.chunked(df, SMALL), sections).collect())
    broken = C.chunked(df, SMALL).withColumn("text", C.F.upper("text"))
    assert {r["check"]: r.failures for r in C.audit(broken, sections).collect()}["locator"] > 0


def test_passages(spark):
    method = "(1) Method statement\nStep 1. Do this.\nStep 2. Do that.\n(2) Next"
    texts = [
        "  " + "A sentence that goes on. " * 40, "Short.", None, method, "Method statement\nStep 1. Only one.", "Intro.\n(7) Of what\n(8) method STATEMENT\nStep 10. One!\nstep 2. Two?\n(9) x",
        "\x1f x" + "y" * 130 + ". And what is cut off " + "z" * 600, "x" * 119 + ".", "x" * 118 + ". ",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, text string")
    got = {r.k: (r.passage, r.starts_at) for r in C.passages(df, "k", "text").collect()}
    assert sorted(got) == [0, 3, 5, 6, 7] and all(C.passages(df, "k", "text").dtypes[n] == t for n, t in enumerate([("k", "bigint"), ("passage", "string"), ("starts_at", "int")]))
    assert got[0] == (("A sentence that goes on. " * 26).strip()[:649], 0) and 120 <= len(got[0][0]) <= 650 and got[0][0].endswith(".")
    assert got[3] == (method[: method.index("\n(2)")], 0)
    assert got[5] == ("(8) method STATEMENT\nStep 10. One!\nstep 2. Two?", 19)
    assert got[6] == ("x" + "y" * 130 + ".", 0) and got[7] == ("x" * 119 + ".", 0)


def test_first_passages_equal_a_loop(spark):
    rng = random.Random(3)
    words = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(6) for b in range(6)]
    some = lambda n: "The " + " ".join(rng.choice(words) for _ in range(n)) + rng.choice([".", "", "?"])
    made = lambda: rng.choice(["", " ", "\t"]) + rng.choice([some(30), some(4), some(40) + " " + some(5), "| " + some(30), "", some(120)]) + rng.choice(["", "  "])
    rows = [(d, s, "\n\n".join(made() for _ in range(rng.randrange(0, 6)))) for d in range(30) for s in range(3)] + [(90, 0, None), (91, 0, "Step words\n\n(1) A method statement. Step 1. One. Step 2. Two.\n(2) next " + "x " * 60)]
    want, offsets = {}, set()
    for d, s, text in rows:
        at = 0
        for k, p in enumerate((text or "").split("\n\n")):
            start, clean = at + len(p) - len(p.lstrip()), p.strip()
            at += len(p) + 2
            offsets.add((d, s, k, start, start + len(clean), clean))
            assert not clean or text[start : start + len(clean)] == clean
            ends = [m.end() for m in re.finditer(r"[.!?](?=\s|$)", clean[:650])]
            if d not in want and len(clean) >= 120 and "|" not in clean and "method statement" not in clean and ends and ends[-1] >= 120 and "worda" in clean[: ends[-1]]:
                want[d] = (s, k, start, start + ends[-1], clean[: ends[-1]])
    df = spark.createDataFrame(rows, "document_id int, section_order int, text string")
    assert {tuple(r) for r in C.paragraphs(df, ["document_id", "section_order"]).collect()} == offsets
    fit = lambda p: p.contains("worda")
    assert {r.document_id: tuple(r)[1:] for r in C.first_passages(df, fit).collect()} == want and len(want) > 10
    method = C.first_passages(df.where("document_id = 91"), lambda p: p.contains("Step")).first()
    assert method.passage == "(1) A method statement. Step 1. One. Step 2. Two." and method.char_start == 12


def test_audit_makes_children_once_and_counts_each_fault(spark):
    section = [("s", "abcdef"), ("t", "xyz")]
    sections = spark.createDataFrame([("d", *x) for x in section] + [("e", "s", "abc"), ("e", "s", "abd")], "document_id string, section_id string, text string")
    rows = [
        ("d", "v", "c1", "p", "text", "s", 0, 3, "abc", 1), ("d", "v", "c1", None, "text", "s", 0, 3, "abd", 0), ("d", "v", "c1", "p", "table", None, None, None, " ", 9), ("d", None, "c2", "p", "text", "u", 0, 3, "abc", 1),
        ("d", "v", "c3", "p", "text", "t", 2, 9, "z", None), ("e", "v", "c4", None, "text", "s", 0, 3, "abc", 1), (None, "v", None, "p", "text", "s", 0, 1, "a", 1), ("d", "v", None, "p", None, "s", 5, 1, None, 1),
    ]
    children = spark.createDataFrame(rows, "document_id string, version_id string, chunk_id string, parent_id string, chunk_type string, section_id string, char_start int, char_end int, text string, text_units int")
    want = {"duplicate_chunk_id": 3, "missing_parent": 2, "sizing": 3, "empty_text": 2, "missing_lineage": 2, "locator": 5}
    assert {r["check"]: r.failures for r in C.audit(children, sections, 8).collect()} == want
    assert {r["check"]: r.failures for r in C.audit(children.where("false"), sections, 8).collect()} == dict.fromkeys(want, 0)
    docs = spark.createDataFrame([("d", "v", "t", [("s", "One sentence here. " * 90)])], "document_id string, version_id string, title string, sections array<struct<section_id:string,text:string>>")
    plan = C.audit(C.chunked(docs, columns=C.AUDITED), sections)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow ") == 1 and "parent_text" not in plan


def test_no_paragraph_after_the_first_that_fits_is_tested(spark):
    from pyspark.sql import functions as F

    part = lambda word: f"The {word} " + "and more words " * 10 + "end."
    df = spark.createDataFrame([(1, 0, f"short\n\n{part('plain')}\n\n {part('good')}\n\n{part('late')}"), (1, 1, part("good")), (2, 0, None)], "document_id int, section_order int, text string")
    fit = lambda p: F.when(p.contains("late"), F.raise_error(F.lit("tested")).cast("boolean")).otherwise(p.contains("good"))
    got = [tuple(r) for r in C.first_passages(df, fit).collect()]
    at = len(f"short\n\n{part('plain')}\n\n ")
    assert got == [(1, 0, 2, at, at + len(part("good")), part("good"))]


def test_every_locator_reason_comes_first_in_its_order(spark):
    text = '{"section_id": "s", "char_start": 0, "char_end": 3, "locator_precision": "exact"}'
    rows = '{"table_id": "t", "row_start": 1, "row_end": 2, "locator_precision": "table_rows"}'
    cases = [
        ("d", "text", "abc", text, None), ("d", "table", "r1\n\nr2", rows, None), ("d", "table", "r2", rows, None), (None, "text", "abc", None, "missing_source_locator"), ("d", "text", "abc", "null", "missing_source_locator"), ("x", "image", "abc", "[]", "invalid_source_locator"), ("d", "text", "abc", "{no", "invalid_source_locator"),
        ("d", "text", "abc", '"s"', "invalid_source_locator"), ("x", "image", "abc", text, "unknown_document_id"), (None, "text", "abc", text, "unknown_document_id"), ("d", "image", "abc", text, "unknown_chunk_type"), ("d", None, "abc", text, "unknown_chunk_type"), ("d", "text", "abc", "{}", "missing_source_section"),
        ("d", "text", "abc", text.replace(": 3", ": 7"), "invalid_character_span"), ("d", "text", "abc", text.replace(": 3", ": 2.5"), "invalid_character_span"), ("d", "text", "abc", text.replace(": 3", ': "3"'), "invalid_character_span"), ("d", "text", "abc", text.replace(": 0", ": 4"), "invalid_character_span"),
        ("d", "text", "abd", text, "inexact_character_span"), ("d", "text", None, text, "inexact_character_span"), ("d", "text", "abc", text.replace("exact", "near"), "invalid_text_locator_precision"), ("d", "table", "r1", rows.replace('"t"', '"u"'), "missing_source_table"), ("d", "table", "r1", rows.replace('"t"', '"e"'), "empty_source_table"),
        ("d", "table", "r1", rows.replace(": 1", ": 0"), "invalid_table_row_range"), ("d", "table", "r1", rows.replace(": 2", ": 4"), "invalid_table_row_range"), ("d", "table", "r1", rows.replace("table_rows", "exact"), "invalid_table_locator_precision"), ("d", "table", "r3", rows, "inexact_table_rows"),
    ]
    children = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "chunk_id int, document_id string, chunk_type string, text string, source_locator string")
    docs = spark.createDataFrame([("d",), ("d",)], "document_id string")
    sections = spark.createDataFrame([("d", "s", "abcdef")], "document_id string, section_id string, text string")
    tables = spark.createDataFrame([("d", "t", ["r1", "r2", "r3"]), ("d", "e", [])], "document_id string, table_id string, lines array<string>")
    got = {r.chunk_id: r.fault for r in C.locator_faults(children, docs, sections, tables).collect()}
    assert [got[k] for k in range(len(cases))] == [c[4] for c in cases] and len({c[4] for c in cases}) == 14


def test_few_documents_are_objects_at_once(spark, monkeypatch):
    import pyarrow as pa

    most = []

    class Batch:
        def __init__(self, batch):
            self.batch, self.num_rows = batch, batch.num_rows

        def slice(self, k, n):
            most.append(n)
            return self.batch.slice(k, n)

    rows = [{"document_id": f"d{k}", "n": k} for k in range(3 * C.DOCUMENTS + 1)]
    assert list(C.documents_of(Batch(pa.RecordBatch.from_pylist(rows)))) == rows and max(most) == C.DOCUMENTS
    monkeypatch.setattr(C, "CHUNKS", 2)
    df = spark.createDataFrame([(f"d{k}", "v", "t", [("s", "One sentence here. " * 900)]) for k in range(5)], "document_id string, version_id string, title string, sections array<struct<section_id:string,text:string>>")
    found = C.chunked(df).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= C.BATCH
    for k in range(5):
        assert sorted(r.chunk_index for r in found if r.document_id == f"d{k}") == list(range(len(found) // 5)) and len(found) > 10
