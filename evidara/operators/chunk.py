"""Structure-aware chunking: sections and tables to blocks, blocks to parents, parents to children with exact offsets.

Blocks are cut natively or in Python where the cut depends on what came before; a document
is one row, as its chunks are numbered through all of its blocks.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import fixed

TOKEN = re.compile(fixed.CHUNK_TOKEN)
BLANK_LINE = re.compile(fixed.BLANK_LINE)
STOPS = frozenset(".!?;")
VERSION = "structure-1"
#: Documents of an Arrow batch, documents that a worker holds as objects, and chunks that it hands over at once.
BATCH, DOCUMENTS, CHUNKS = 512, 16, 256


@dataclass(frozen=True)
class Sizes:
    parent_target: int = fixed.PARENT_TARGET
    parent_max: int = fixed.PARENT_MAX
    child_target: int = fixed.CHILD_TARGET
    child_max: int = fixed.CHILD_MAX
    overlap: int = fixed.OVERLAP

    def __post_init__(self):
        if not (0 <= self.overlap < self.child_target <= self.child_max and self.parent_target <= self.parent_max):
            raise ValueError("sizes do not fit together")


def spans(text: str, target: int, most: int, overlap: int = 0) -> list[tuple[int, int, int]]:
    """(from, to, tokens) in characters: windows of tokens that end at a sentence or paragraph near the target, or hard at it."""
    found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    n = len(found)
    ends = [k + 1 for k in range(n - 1) if text[found[k][0] : found[k][1]] in STOPS or BLANK_LINE.search(text, found[k][1], found[k + 1][0])]
    out, at = [], 0
    while at < n:
        if n - at <= most:
            end = n
        else:
            low, high = at + max(1, target // 2), at + most
            near = ends[bisect.bisect_left(ends, low) : bisect.bisect_right(ends, high)]
            end = min(near, key=lambda e: (abs(e - at - target), e)) if near else at + target
        out.append((found[at][0], found[end - 1][1], end - at))
        if end == n:
            break
        at = max(at + 1, end - overlap) if overlap else end
    return out


def segments(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of a section between its pipe-delimited table lines, stripped."""
    at, begin = 0, None
    for line in [*text.splitlines(keepends=True), None]:
        bare = line.strip() if line is not None else ""
        is_table = line is not None and bare[:1] == "|" == bare[-1:]
        if (line is None or is_table) and begin is not None:
            raw = text[begin:at]
            if raw.strip():
                start = begin + len(raw) - len(raw.lstrip())
                yield start, start + len(raw.strip())
            begin = None
        elif line is not None and not is_table and begin is None:
            begin = at
        at += len(line or "")


def table_lines(headers: list[str] | None, matrix: list[list[str]] | None) -> list[str]:
    """A line of `label: value` cells for each row; a table of headers alone is one line of them."""
    clean = lambda row: ["" if c is None else str(c).strip() for c in row]
    head, rows = clean(headers or []), [clean(r) for r in matrix or []]
    if rows and (not head or rows[0] == head):
        head, rows = head or rows[0], rows[1:]
    label = lambda k: head[k] if k < len(head) and head[k] else f"Column {k + 1}"
    lines = [" | ".join(f"{label(k)}: {row[k] if k < len(row) else ''}" for k in range(max(len(head), len(row)))) for row in rows]
    return lines or ([" | ".join(head)] if head else [])


def _hash(*parts: str) -> str:
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


def _identity(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def blocks(document: dict) -> Iterator[dict]:
    for s in document.get("sections") or []:
        text = s.get("text") or ""
        if text.lstrip().startswith("{\\rtf"):
            continue
        path = [p for p in s.get("heading_path") or [] if p] or ([s["heading"]] if s.get("heading") else [])
        for a, b in segments(text):
            yield {"kind": "text", "section_id": s.get("section_id"), "path": path, "text": text[a:b], "at": a, "rows": []}
    for k, t in enumerate(document.get("tables") or []):
        lines = table_lines(t.get("headers"), t.get("matrix"))
        rows, at = [], 0
        for line in lines:
            rows.append((at, at + len(line)))
            at += len(line) + 2
        if lines:
            name = str(t.get("table_id") or f"table_{k}")
            yield {"kind": "table", "section_id": t.get("section_id"), "table_id": name, "page_number": t.get("page_number"), "path": [document.get("title") or "Untitled", f"Table {name}"], "text": "\n\n".join(lines), "at": 0, "rows": rows}


def chunks(document: dict, sizes: Sizes = Sizes()) -> Iterator[dict]:
    """Children of a document, each with its parent; numbering runs through the document."""
    parents = children = 0
    for b in blocks(document):
        text = b["text"]
        for part, (pa_, pb, pn) in enumerate(spans(text, sizes.parent_target, sizes.parent_max)):
            inner = text[pa_:pb]
            where = json.dumps({"kind": b["kind"], "section": b["section_id"], "table": b.get("table_id"), "at": b["at"], "part": part}, sort_keys=True)
            parent = _hash(document["document_id"], document["version_id"], "parent", where, _identity(inner), VERSION)
            for ca, cb, cn in spans(inner, sizes.child_target, sizes.child_max, sizes.overlap if b["kind"] == "text" else 0):
                start, end = pa_ + ca, pa_ + cb
                touched = [k for k, (x, y) in enumerate(b["rows"], 1) if x < end and y > start]
                row = {
                    "parent_id": parent, "parent_index": parents, "parent_units": pn, "parent_text": inner, "chunk_index": children, "chunk_type": b["kind"], "section_id": b["section_id"], "heading_path": b["path"],
                    "table_id": b.get("table_id"), "page_number": b.get("page_number"), "row_start": min(touched, default=None), "row_end": max(touched, default=None),
                    "char_start": b["at"] + start if b["kind"] == "text" else None, "char_end": b["at"] + end if b["kind"] == "text" else None, "text": inner[ca:cb], "text_units": cn,
                }
                place = json.dumps({k: row[k] for k in ("section_id", "table_id", "page_number", "row_start", "row_end", "char_start", "char_end", "chunk_index")} | {"part": part}, sort_keys=True)
                row["chunk_id"] = _hash(document["document_id"], document["version_id"], place, _identity(row["text"]), VERSION)
                yield row
                children += 1
            parents += 1


CHUNK_DDL = (
    "document_id string, version_id string, chunk_id string, parent_id string, parent_index int, parent_units int, parent_text string, chunk_index int, chunk_type string, section_id string, heading_path array<string>, "
    "table_id string, page_number int, row_start int, row_end int, char_start int, char_end int, text string, text_units int"
)
_STRINGS, _INTS = pa.string(), pa.int32()
CHUNK = pa.schema(
    [(n, pa.list_(pa.string()) if n == "heading_path" else _INTS if n in {"parent_index", "parent_units", "chunk_index", "page_number", "row_start", "row_end", "char_start", "char_end", "text_units"} else _STRINGS) for n in (c.split()[0] for c in CHUNK_DDL.split(", "))]
)


def documents_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch as objects, DOCUMENTS at a time."""
    for k in range(0, batch.num_rows, DOCUMENTS):
        yield from batch.slice(k, DOCUMENTS).to_pylist()


def small_batches(spark: SparkSession) -> None:
    """Documents are long, and a worker holds a whole Arrow batch of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


def chunked(documents: DataFrame, sizes: Sizes = Sizes(), columns: list[str] | None = None) -> DataFrame:
    """Children of documents (document_id, version_id, title, sections, tables): a map, no shuffle.

    columns: those that are wanted, else all. Workers hand over no others; a parent's text goes with each of its children.
    """
    schema = pa.schema([f for f in CHUNK if columns is None or f.name in columns])
    ddl = ", ".join(c for c in CHUNK_DDL.split(", ") if c.split()[0] in schema.names)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = ({"document_id": d["document_id"], "version_id": d["version_id"], **c} for d in documents_of(batch) for c in chunks(d, sizes))
            while some := list(islice(rows, CHUNKS)):
                yield pa.RecordBatch.from_pylist(some, schema=schema)

    small_batches(documents.sparkSession)
    wanted = [c for c in ("document_id", "version_id", "title", "sections", "tables") if c in documents.columns]
    return documents.select(*wanted).mapInArrow(run, ddl)


def parents_of(children: DataFrame) -> DataFrame:
    """One row per parent."""
    first = children.groupBy("parent_id", "document_id", "version_id", "parent_index").agg(F.first("parent_text").alias("content"), F.first("parent_units").alias("text_units"), F.count(F.lit(1)).alias("children"))
    return first


def sizing_fault(text_units: Column, most: Column | int) -> Column:
    return F.when(text_units.isNull() | (text_units < 1), "empty").when(text_units > most, "oversize")


#: What an audit reads of children.
AUDITED = ["document_id", "version_id", "chunk_id", "parent_id", "chunk_type", "section_id", "char_start", "char_end", "text", "text_units"]


def located(children: DataFrame, sections: DataFrame, more: list[str]) -> DataFrame:
    """(chunk_id, more, fault) of all children, one row for each section of theirs: null for those that are not text or whose located characters are their text."""
    is_text = F.col("chunk_type").eqNullSafe("text")
    sources = sections.select(F.col("document_id").alias("_document"), F.col("section_id").alias("_section"), F.col("text").alias("source"))
    j = children.join(sources, is_text & (F.col("document_id") == F.col("_document")) & (F.col("section_id") == F.col("_section")), "left")
    n = F.length("source")
    fault = (
        F.when(F.col("source").isNull(), "missing_source_section")
        .when(F.col("char_start").isNull() | F.col("char_end").isNull() | (F.col("char_start") < 0) | (F.col("char_start") > F.col("char_end")) | (F.col("char_end") > n), "invalid_character_span")
        .when(F.substring(F.col("source"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) != F.col("text"), "inexact_character_span")
    )
    return j.select("chunk_id", *more, F.when(is_text, fault).alias("fault"))


def locator_fault(children: DataFrame, sections: DataFrame) -> DataFrame:
    """(chunk_id, fault) of text chunks: null where the located characters are the chunk's text."""
    return located(children.where("chunk_type = 'text'"), sections, [])


def audit(children: DataFrame, sections: DataFrame, most: int = fixed.CHILD_MAX) -> DataFrame:
    """(check, failures) for duplicates, lineage, sizes and locators; a valid export has zeros.

    One pass over the children, which are dear to make: each meets its source once, and what is found of it goes
    on as counts. A child whose section is there several times is held against each of them, and still is one child.
    """
    n = F.col("n")
    once = {
        "missing_parent": F.col("parent_id").isNull(),
        "sizing": sizing_fault(F.col("text_units"), most).isNotNull(),
        "empty_text": F.coalesce(F.trim("text"), F.lit("")) == "",
        "missing_lineage": F.col("document_id").isNull() | F.col("version_id").isNull(),
    }
    rows = children.select("chunk_id", "chunk_type", "document_id", "section_id", "char_start", "char_end", "text", F.monotonically_increasing_id().alias("row"), *(F.coalesce(c, F.lit(False)).alias(k) for k, c in once.items()))
    judged = located(rows, sections, ["row", *once])
    each = judged.groupBy("chunk_id", "row", *once).agg(F.count("fault").alias("locator"))
    same = each.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(k).alias(k) for k in once), F.sum("locator").alias("locator"))
    found = same.agg(F.sum(n - 1).alias("duplicate_chunk_id"), *(F.sum(k).alias(k) for k in (*once, "locator")))
    return found.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.coalesce(c, F.lit(0)).cast("bigint").alias("failures")) for c in found.columns))).alias("x")).select("x.check", "x.failures")


def bounded_passage(text: Column) -> Column:
    """struct(passage, starts_at) of a text, or null.

    Where it has a method statement: the numbered part that holds it, if that names two steps or more and ends with a
    sentence. Else the whole sentences at its head, as many as fit into PASSAGE_MOST characters, if they make PASSAGE_LEAST.
    """
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    begins = F.instr(F.lower(clean), fixed.METHOD_STATEMENT)  # counted from 1, 0 for none
    above = F.regexp_extract(F.substring(clean, F.lit(1), begins - 1), r"(?s)^(.*\n|)\(\d+\)", 1)
    below = F.substring(clean, begins + 1, F.length(clean))
    inner = F.when(below.rlike(r"\n\(\d+\)"), F.regexp_extract(below, r"(?s)^(.*?)\n\(\d+\)", 1)).otherwise(below)
    part = F.rtrim(F.substring(clean, F.length(above) + 1, begins + F.length(inner) - F.length(above)))
    part = F.regexp_replace(part, r"(?U)\s+$", "")
    steps = F.array_distinct(F.transform(F.regexp_extract_all(part, F.lit(fixed.METHOD_STEP), F.lit(1)), lambda n: n.cast("decimal(38)")))
    method = F.when((F.size(steps) >= 2) & part.rlike(r"[.!?]\z"), F.struct(part.alias("passage"), F.length(above).cast("int").alias("starts_at")))
    head = F.regexp_extract(F.substring(clean, 1, fixed.PASSAGE_MOST), r"(?sU)^(.*[.!?])(?=\s|\z)", 1)
    plain = F.when(F.length(head) >= fixed.PASSAGE_LEAST, F.struct(head.alias("passage"), F.lit(0).alias("starts_at")))
    return F.when(begins > 0, method).otherwise(plain)


def passages(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, passage, starts_at) of the bounded passage of each text that has one."""
    found = docs.select(F.col(key).cast("bigint").alias(key), bounded_passage(F.col(text)).alias("p")).where("p is not null")
    return found.select(key, "p.passage", "p.starts_at")


def paragraphs(sections: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, paragraph, char_start, char_end, content) of sections (keys, text): texts parted at blank lines, ends stripped; a row's keys name its section.

    Offsets run on by each paragraph and the two characters after it. They come from lengths alone, within
    the section's row, so nothing is shuffled.
    """
    parts = F.split(F.coalesce(text, F.lit("")), "\n\n")
    size = F.transform("_parts", lambda p: F.length(p) + 2)
    ends = F.aggregate(size, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["all"], a["at"]).alias("all")), lambda a: a["all"])
    rows = sections.withColumn("_parts", parts).withColumn("_starts", ends).select(*keys, F.posexplode(F.arrays_zip("_parts", "_starts")).alias("paragraph", "p"))
    lead = F.length("p._parts") - F.length(F.regexp_replace("p._parts", r"(?U)^[\s\x1c-\x1f]+", ""))
    content = F.regexp_replace("p._parts", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    start = F.col("p._starts") + lead
    return rows.select(*keys, "paragraph", start.alias("char_start"), (start + F.length(content)).alias("char_end"), content.alias("content"))


def first_passages(sections: DataFrame, fit: Callable[[Column], Column], document: str = "document_id", section: str = "section_order") -> DataFrame:
    """(document, section, paragraph, char_start, char_end, passage): of each document (document, section, text) the first passage that fits.

    Paragraphs of PASSAGE_LEAST characters and more without table bars are bounded; `fit` tells a passage of substance. A section is
    gone through in order, and no paragraph after its first that fits is bounded or tested: those behind it cannot be
    the document's. Of all sections with one the document's first is a minimum, so one row a document and task is shuffled.
    """
    strip = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
    let = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  a value that is used more than once

    def tested(part: Column, paragraph: Column, at: Column) -> Column:
        start = at + F.length(part) - F.length(F.regexp_replace(part, r"(?U)^[\s\x1c-\x1f]+", ""))
        place = lambda b: F.struct(paragraph.alias("paragraph"), (start + b["starts_at"]).alias("char_start"), (start + b["starts_at"] + F.length(b["passage"])).alias("char_end"), b["passage"].alias("passage"))
        fits = lambda b: F.when(b.isNotNull() & fit(b["passage"]), place(b))
        return let(F.regexp_replace(part, strip, ""), lambda c: F.when((F.length(c) >= fixed.PASSAGE_LEAST) & ~c.contains("|"), let(bounded_passage(c), fits)))

    none = F.lit(None).cast("struct<paragraph:int,char_start:int,char_end:int,passage:string>")
    step = lambda a, part: F.struct((a["paragraph"] + 1).alias("paragraph"), (a["at"] + F.length(part) + 2).alias("at"), F.coalesce(a["found"], tested(part, a["paragraph"], a["at"])).alias("found"))
    begin = F.struct(F.lit(0).alias("paragraph"), F.lit(0).alias("at"), none.alias("found"))
    # exploded, so that the test for null reads what was found instead of finding it again
    first = F.aggregate(F.split(F.coalesce("text", F.lit("")), "\n\n"), begin, step, lambda a: F.array_compact(F.array(a["found"])))
    found = sections.select(document, section, F.explode(first).alias("p"))
    return found.groupBy(document).agg(F.min_by(F.struct(section, "p.*"), F.struct(section, "p.paragraph")).alias("r")).select(document, "r.*")


def table_locator_fault(children: DataFrame, tables: DataFrame) -> DataFrame:
    """(chunk_id, fault) of table chunks: null where the located rows hold the chunk's text. tables: document_id, table_id, lines."""
    j = children.where("chunk_type = 'table'").join(tables.select("document_id", "table_id", "lines"), ["document_id", "table_id"], "left")
    claimed = F.array_join(F.slice("lines", F.greatest("row_start", F.lit(1)), F.greatest(F.col("row_end") - F.col("row_start") + 1, F.lit(0))), "\n\n")
    fault = (
        F.when(F.col("lines").isNull(), "missing_source_table")
        .when(F.size("lines") == 0, "empty_source_table")
        .when(F.col("row_start").isNull() | F.col("row_end").isNull() | (F.col("row_start") < 1) | (F.col("row_start") > F.col("row_end")) | (F.col("row_end") > F.size("lines")), "invalid_table_row_range")
        .when(~claimed.contains(F.col("text")), "inexact_table_rows")
    )
    return j.select("chunk_id", fault.alias("fault"))


def lines_of_tables(documents: DataFrame) -> DataFrame:
    """(document_id, table_id, lines) of documents with tables."""
    schema = pa.schema([("document_id", pa.string()), ("table_id", pa.string()), ("lines", pa.list_(pa.string()))])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            rows = ({"document_id": d["document_id"], "table_id": str(t.get("table_id") or f"table_{k}"), "lines": table_lines(t.get("headers"), t.get("matrix"))} for d in documents_of(batch) for k, t in enumerate(d["tables"] or []))
            while some := list(islice(rows, CHUNKS)):
                yield pa.RecordBatch.from_pylist(some, schema=schema)

    small_batches(documents.sparkSession)
    return documents.select("document_id", "tables").mapInArrow(run, "document_id string, table_id string, lines array<string>")


def locator_faults(children: DataFrame, documents: DataFrame, sections: DataFrame, tables: DataFrame) -> DataFrame:
    """(chunk_id, fault) of children (chunk_id, document_id, chunk_type, text, source_locator as JSON): the first reason why a locator does not hold, or null.

    documents: document_id; sections: document_id, section_id, text; tables: document_id, table_id, lines. Thirteen
    reasons in order: of the locator, the document and the kind of chunk, then of the section and its
    characters, or of the table and its rows. Sources meet chunks in joins on their ids.
    """
    v = F.try_parse_json("source_locator")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    whole = lambda name: F.when(kind(name) == "BIGINT", F.try_variant_get(v, f"$.{name}", "bigint"))
    said = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    rows = children.select(
        "chunk_id", "document_id", "chunk_type", "text", (F.col("source_locator").isNull() | (F.schema_of_variant(v) == "VOID")).alias("missing"), F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("valid"),
        said("section_id").alias("section_id"), said("table_id").alias("table_id"), said("locator_precision").alias("precision"), *(whole(n).alias(n) for n in ("char_start", "char_end", "row_start", "row_end")),
    )
    known = documents.select("document_id", F.lit(True).alias("known")).distinct()
    rows = rows.join(known, "document_id", "left").join(sections.select("document_id", "section_id", F.col("text").alias("source")), ["document_id", "section_id"], "left").join(tables.select("document_id", "table_id", "lines"), ["document_id", "table_id"], "left")
    start, end, first, last = F.col("char_start"), F.col("char_end"), F.col("row_start"), F.col("row_end")
    in_text = (0 <= start) & (start <= end) & (end <= F.length("source"))
    in_table = (1 <= first) & (first <= last) & (last <= F.size("lines"))
    of_text = (
        F.when(F.col("source").isNull(), "missing_source_section")
        .when(~F.coalesce(in_text, F.lit(False)), "invalid_character_span")
        .when(~F.substring("source", (start + 1).cast("int"), (end - start).cast("int")).eqNullSafe(F.col("text")), "inexact_character_span")
        .when(~F.col("precision").eqNullSafe("exact"), "invalid_text_locator_precision")
    )
    claimed = F.array_join(F.slice("lines", first.cast("int"), (last - first + 1).cast("int")), "\n\n")
    of_table = (
        F.when(F.col("lines").isNull(), "missing_source_table")
        .when(F.size("lines") == 0, "empty_source_table")
        .when(~F.coalesce(in_table, F.lit(False)), "invalid_table_row_range")
        .when(~F.col("precision").eqNullSafe("table_rows"), "invalid_table_locator_precision")
        .when(~F.coalesce(claimed.contains(F.col("text")), F.lit(False)), "inexact_table_rows")
    )
    fault = (
        F.when(F.col("missing"), "missing_source_locator")
        .when(~F.col("valid"), "invalid_source_locator")
        .when(F.col("known").isNull(), "unknown_document_id")
        .when(F.col("chunk_type").eqNullSafe("text"), of_text)
        .when(F.col("chunk_type").eqNullSafe("table"), of_table)
        .otherwise("unknown_chunk_type")
    )
    return rows.select("chunk_id", fault.alias("fault"))
