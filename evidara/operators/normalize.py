"""Metadata normalisation: canonical urls, lifecycle and authority, citations, section ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import fixed

AUTHORITY_VERSION = "authority-classification-v1"
CITATION_VERSION = "citation-evidence-v3"
SECTION_VERSION = "legislation-section-v1"

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def unquoted(c: Column) -> Column:
    """Percent signs decoded, plus signs left; the text itself where it cannot be decoded."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _quoted(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def url_key(url: Column) -> Column:
    """One identity for spellings of a url: case of scheme, host and parameter names, escapes and order of parameters."""
    u = F.trim(_text(url))
    part = lambda k: F.regexp_extract(u, _URL, k)
    plus = lambda c: F.coalesce(F.try_url_decode(c), c)
    pieces = F.filter(F.split(part(4), "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            F.lower(unquoted(plus(F.substring_index(p, "=", 1)))).alias("name"),
            unquoted(plus(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, r"^[^=]*=", "")).otherwise(F.lit("")))).alias("value"),
        ),
    )
    query = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_quoted(p["name"]), F.lit("="), _quoted(p["value"]))), "&")
    scheme = F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit(":"))).otherwise("")
    host = F.when(part(2) != "", F.concat(F.lit("//"), F.lower(part(2)))).otherwise("")
    return F.concat(scheme, host, unquoted(part(3)), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""), F.when(part(5) != "", F.concat(F.lit("#"), part(5))).otherwise(""))


def lifecycle_status(title: Column, reference: Column, url: Column, status: Column) -> Column:
    evidence = F.concat_ws(" ", _text(title), _text(reference), unquoted(_text(url)))
    said = F.lower(_text(status))
    return (
        F.when((said == "withdrawn") | evidence.rlike(fixed.WITHDRAWN_REFERENCE), "withdrawn")
        .when((said == "draft") | F.lower(evidence).contains(fixed.DRAFT_PHRASE) | evidence.rlike(fixed.DRAFT_REFERENCE), "draft")
        .otherwise(F.coalesce(F.nullif(status, F.lit("")), F.lit("current")))
    )


def source_class(title: Column, url: Column, declared: Column) -> Column:
    """Legislation is told apart by its title and register; other classes stand."""
    register = F.lower(unquoted(_text(url))).contains("docid=pac/")
    return (
        F.when(~declared.eqNullSafe(F.lit("primary_legislation")), declared)
        .when(register & _text(title).rlike(fixed.REGULATION_TITLE), "commonwealth_regulation")
        .when(register & _text(title).rlike(fixed.ACT_TITLE), "commonwealth_statute")
        .otherwise("ato_public_guidance")
    )


def with_authority(docs: DataFrame) -> DataFrame:
    """Adds source_class, page_status, binding_effect, authority_rank and what they were before; rows of this rule version stay."""
    done = F.coalesce(F.col("classification_resolution.rule_version") == AUTHORITY_VERSION, F.lit(False)) if "classification_resolution" in docs.columns else F.lit(False)
    kind = source_class(F.col("title"), F.col("source_url"), F.col("source_class"))
    status = lifecycle_status(F.col("title"), F.col("canonical_reference_id"), F.col("source_url"), F.col("page_status"))
    law, guidance = kind.isin("commonwealth_statute", "commonwealth_regulation"), kind == "ato_public_guidance"
    effect = F.when(status == "withdrawn", "withdrawn").when(status == "draft", "non_binding_draft").when(law, "binding_law").when(guidance, "non_binding_guidance").otherwise(F.col("binding_effect"))
    rank = F.when(status == "withdrawn", fixed.WITHDRAWN_RANK).when(status == "draft", fixed.DRAFT_RANK).when(law, fixed.LAW_RANK).when(guidance, fixed.GUIDANCE_RANK).otherwise(F.col("authority_rank"))
    before = F.struct(
        F.col("source_class").alias("original_source_class"), F.col("page_status").alias("original_page_status"),
        F.col("binding_effect").alias("original_binding_effect"), F.col("authority_rank").alias("original_authority_rank"), F.lit(AUTHORITY_VERSION).alias("rule_version"),
    )
    new = {"source_class": kind, "page_status": status, "binding_effect": effect, "authority_rank": rank, "classification_resolution": before}
    if "classification_resolution" in docs.columns:
        return docs.withColumns({c: F.when(done, F.col(c)).otherwise(v) for c, v in new.items()})
    return docs.withColumns(new)


_KNOWN = "|".join(fixed.RULING_PREFIXES)


def citation_from_url(url: Column) -> Column:
    """A citation that the url's file name or document id spells, or null."""
    whole = unquoted(_text(url))
    named = F.when(whole.contains("filename="), F.substring_index(F.regexp_replace(whole, r"(?s)^.*?filename=", ""), "&", 1)).otherwise(whole)
    plain = F.regexp_replace(F.substring_index(F.substring_index(named, "?", 1), "#", 1), r"/+$", "")
    name = F.regexp_replace(F.substring_index(plain, "/", -1), r"(?i)\.pdf$", "")
    of_file = fixed.CITATION_IN_FILE
    prefix = F.upper(F.regexp_extract(name, of_file, 1))
    by_file = F.when(
        prefix.isin(fixed.RULING_PREFIXES),
        F.concat(prefix, F.lit(" "), F.regexp_extract(name, of_file, 2), F.lit("/"), F.regexp_extract(name, of_file, 3).cast("bigint").cast("string")),
    )
    of_id = fixed.CITATION_IN_ID
    kind, digits = F.upper(F.regexp_extract(whole, of_id, 1)), F.regexp_extract(whole, of_id, 2)
    cut = F.when(digits.rlike("^(19|20)"), 4).otherwise(2)
    year, number = F.substring(digits, F.lit(1), cut), F.substring(digits, cut + 1, F.lit(100))
    by_id = F.when(kind.isin("MT", "TD") & (number != ""), F.concat(kind, F.lit(" "), year, F.lit("/"), number.try_cast("bigint").cast("string")))
    return F.coalesce(by_file, by_id)


def _cited(c: Column) -> tuple[Column, Column, Column]:
    """prefix, year, number"""
    return F.substring_index(c, " ", 1), F.regexp_extract(c, r" ([^/]*)", 1), F.when(c.contains("/"), F.regexp_replace(c, r"^[^/]*/", "")).otherwise("")


def citation_in_title(title: Column, derived: Column) -> Column:
    """The title's first citation of the same ruling, in the title's own short or long form."""
    prefix, year, number = _cited(derived)
    pattern = rf"(?i)\b({_KNOWN})\s+(\d{{2}}|\d{{4}})/(\d+)\b"
    found = F.regexp_extract_all(_text(title), F.lit(pattern), F.lit(0))

    def same(f: Column) -> Column:
        y = F.regexp_extract(f, pattern, 2)
        near = (y == year) | ((year.try_cast("int") < 2000) & year.endswith(y))
        return (F.upper(F.regexp_extract(f, pattern, 1)) == prefix) & near & (F.regexp_extract(f, pattern, 3).try_cast("bigint") == number.try_cast("bigint"))

    first = F.get(F.filter(found, same), F.lit(0))
    return F.concat(F.upper(F.regexp_extract(first, pattern, 1)), F.lit(" "), F.regexp_extract(first, pattern, 2), F.lit("/"), F.regexp_extract(first, pattern, 3).try_cast("bigint").cast("string"))


def resolved_citation(title: Column, url: Column, original: Column) -> Column:
    """struct(original, value, resolution, evidence, rule_version)"""

    def said(value: Column | None, resolution: str | Column, evidence: Column | str | None) -> Column:
        e = F.lit(evidence) if evidence is None or isinstance(evidence, str) else evidence
        r = F.lit(resolution) if isinstance(resolution, str) else resolution
        v = F.lit(None) if value is None else value
        return F.struct(original.alias("original"), v.cast("string").alias("value"), r.alias("resolution"), e.cast("string").alias("evidence"), F.lit(CITATION_VERSION).alias("rule_version"))

    derived = citation_from_url(url)
    titled = citation_in_title(title, derived)
    p, y, n = _cited(original)
    dp, dy, dn = _cited(derived)
    years = (y == dy) | ((F.length(y) == 2) & dy.endswith(y)) | ((F.length(dy) == 2) & y.endswith(dy))
    return (
        F.when(original.isNull() | ~original.rlike(rf"^(?:{_KNOWN}) "), said(original, "not_evaluated", None))
        .when(derived.isNull() & _text(title).contains(original), said(original, "confirmed", "title"))
        .when(derived.isNull(), said(original, "uncorroborated", None))
        .when(titled.isNotNull() & (titled != derived), said(titled, F.when(titled == original, "confirmed").otherwise("normalized"), "title+source_url"))
        .when(p != dp, said(None, "flagged", "prefix mismatch"))
        .when(years & n.startswith(dn), said(original, "confirmed", "source_url"))
        .when(years, said(None, "flagged", "number mismatch"))
        .when((F.length(y) == 2) & dy.startswith(y), said(derived, "normalized", "source_url"))
        .otherwise(said(None, "flagged", "year mismatch"))
    )


def legislation_section(document_id: Column, url: Column, declared: Column) -> Column:
    """struct(value, register_id, section, definition, rule_version) where document id, fragment and register agree, else null."""
    parts = F.split(F.regexp_replace(document_id, "^leg-", ""), "-")
    section = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "-")
    register = F.get(parts, F.lit(0))
    stated = _text(declared)
    fragment = F.when(_text(url).contains("#"), F.regexp_replace(_text(url), r"(?s)^[^#]*#", "")).otherwise("")
    low, value = F.lower(section), F.lower(fragment)
    shape = fixed.DEFINITION_ID
    head, slug = F.regexp_extract(low, shape, 1), F.regexp_extract(low, shape, 2)
    rendered = (
        F.when(low == value, F.struct(fragment.alias("section"), F.lit(None).cast("string").alias("definition")))
        .when((slug != "") & (value == slug), F.struct(section.alias("section"), slug.alias("definition")))
        .when((slug != "") & value.startswith(slug), F.struct(F.concat(head, F.lit("-def-"), value).alias("section"), value.alias("definition")))
        .when((slug == "") & low.endswith(F.concat(F.lit("-"), value)), F.struct(section.alias("section"), F.lit(None).cast("string").alias("definition")))
    )
    name = F.upper(F.coalesce(F.nullif(stated, F.lit("")), register))
    agrees = document_id.startswith("leg-") & (F.size(parts) >= 3) & (section != "") & ((stated == "") | (F.upper(stated) == F.upper(register))) & (fragment != "")
    return F.when(
        agrees & rendered.isNotNull(),
        F.struct(F.concat(name, F.lit("#"), rendered["section"]).alias("value"), name.alias("register_id"), rendered["section"].alias("section"), rendered["definition"].alias("definition"), F.lit(SECTION_VERSION).alias("rule_version")),
    )


def with_sections(docs: DataFrame) -> DataFrame:
    """Rewrites section_id in every section and keeps the old one as source_section_id; needs sections with both fields."""
    found = legislation_section(F.col("document_id"), F.col("source_url"), F.col("register_id"))
    rewritten = F.transform(
        "sections",
        lambda s: F.when(s["section_id"].eqNullSafe(F.col("section_id_resolution.value")), s).otherwise(s.withField("source_section_id", s["section_id"]).withField("section_id", F.col("section_id_resolution.value"))),
    )
    out = docs.withColumn("section_id_resolution", found)
    return out.withColumn("sections", F.when(F.col("section_id_resolution").isNotNull() & (F.size("sections") > 0), rewritten).otherwise(F.col("sections")))


def with_citation(docs: DataFrame) -> DataFrame:
    """canonical_reference_id and canonical_reference by the rules in force.

    Rows of the current version stay. Rows of an earlier one are resolved anew only on evidence: the title's
    form of the citation, or an id that earlier versions did not read, says something else than the row does.
    """
    if "canonical_reference" not in docs.columns:
        first = F.col("canonical_reference_id")
        out = docs.withColumn("canonical_reference", resolved_citation(F.col("title"), F.col("source_url"), first))
        return out.withColumn("canonical_reference_id", F.col("canonical_reference.value"))
    current, prior = F.col("canonical_reference_id"), F.col("canonical_reference")
    derived = citation_from_url(F.col("source_url"))
    titled = citation_in_title(F.col("title"), derived)
    by_title = titled.isNotNull() & ~titled.eqNullSafe(current)
    by_id = F.coalesce(derived.rlike("^(?:MT|TD) "), F.lit(False)) & (~derived.eqNullSafe(current) | ~prior["evidence"].eqNullSafe("source_url"))
    stays = prior["rule_version"].isNotNull() & ((prior["rule_version"] == CITATION_VERSION) | ~(by_title | by_id))
    out = docs.withColumn("_stays", F.coalesce(stays, F.lit(False)))
    anew = resolved_citation(F.col("title"), F.col("source_url"), F.coalesce(prior["original"], current))
    out = out.withColumn("canonical_reference", F.when(F.col("_stays"), prior).otherwise(anew))
    return out.withColumn("canonical_reference_id", F.when(F.col("_stays"), current).otherwise(F.col("canonical_reference.value"))).drop("_stays")


def normalized(docs: DataFrame) -> DataFrame:
    """Sections, authority and citation in turn; applying it again changes nothing."""
    return with_citation(with_authority(with_sections(docs)))
