"""Text as columns: tokens, terms, identifiers, digests. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidara.functions import fixed

TOKEN = r"(?U)\w+(?:['’\-]\w+)*|[^\w\s]"
TERM = r"[a-z0-9]{2,}"


def nothing() -> Column:
    return F.lit("")


def lexical_tokens(text: Column) -> Column:
    """Words (with inner apostrophes and hyphens) and single symbols, in order."""
    return F.regexp_extract_all(F.coalesce(text, nothing()), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(lexical_tokens(text))


def identity_text(text: Column) -> Column:
    """White space collapsed and stripped: the form that identities are computed from."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, nothing()), r"(?U)\s+", " "), "^ | $", "")


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), nothing()) for p in parts)), 256)


def without_tables(text: Column) -> Column:
    """Text without its pipe-delimited lines, blank lines reduced to one."""
    cleaned = F.regexp_replace(F.coalesce(text, nothing()), r"(?m)^\s*\|.*\|\s*$", "")
    return F.regexp_replace(F.regexp_replace(cleaned, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """Lower case with sharp s folded."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normal_identifier(value: Column) -> Column:
    return F.regexp_replace(fold(value), r"[^\p{L}\p{N}]", "")


def _paragraph(number: Column) -> Column:
    return F.concat(F.lit("para"), normal_identifier(number))


def identifiers(query: Column) -> Column:
    """Normalised identifiers of a query, pattern by pattern, each once, in order."""
    found = []
    last = len(fixed.IDENTIFIER_PATTERNS) - 1
    for k, (pattern, group) in enumerate(fixed.IDENTIFIER_PATTERNS):
        values = F.regexp_extract_all(F.coalesce(query, nothing()), F.lit(pattern), F.lit(group))
        found.append(F.transform(values, _paragraph if k == last else normal_identifier))
    return F.array_distinct(F.filter(F.flatten(F.array(*found)), lambda v: v != ""))


def lexical_terms(query: Column) -> Column:
    """The words of a query that full-text search looks for; the query itself if none is left."""
    value = query
    for pattern, _ in fixed.IDENTIFIER_PATTERNS:
        value = F.regexp_replace(value, pattern, " ")
    words = F.regexp_extract_all(F.lower(value), F.lit(r"[a-z0-9]+(?:[-.][a-z0-9]+)*"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(fixed.GENERIC_TERMS))
    return F.coalesce(F.nullif(F.array_join(kept, " "), nothing()), query)


def prefers_opening(ids: Column) -> Column:
    """A court decision is asked for and no paragraph of it."""
    return F.exists(ids, lambda i: i.rlike(r"^\d{4}(?:hca|fcafc|fca)\d+$")) & ~F.exists(ids, lambda i: i.startswith("para"))


def expand_acronym(query: Column, acronym: str = "ATO", full: str = "Australian Taxation Office") -> Column:
    """The full name before an acronym, unless it already stands there."""
    return F.regexp_replace(query, rf"(?i)(?<!{full.lower()} \()\b{acronym}\b", f"{full} ({acronym})")


def term_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, nothing())), F.lit(TERM), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct terms; 1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def redacted(text: Column, classification: Column) -> Column:
    mark = F.concat(F.lit("[REDACTED_CONTENT:sha256="), F.substring(F.sha2(text, 256), 1, 16), F.lit(":len="), F.length(text).cast("string"), F.lit("]"))
    return F.when(classification.isin(fixed.PUBLIC_CLASSIFICATIONS), text).otherwise(mark)


def redacted_metadata(metadata: Column, classification: Column) -> Column:
    """A string map with text redacted; numbers and the allow-listed keys pass."""

    def value(k: Column, v: Column) -> Column:
        plain = k.isin(fixed.KEPT_METADATA) | v.rlike(r"^(?:-?\d+(?:\.\d+)?|true|false)$")
        complex_ = v.rlike(r"^[\[{]")
        return F.when(classification.isin(fixed.PUBLIC_CLASSIFICATIONS) | plain, v).when(complex_, F.lit("[REDACTED_COMPLEX_DATA]")).otherwise(redacted(v, classification))

    return F.transform_values(metadata, value)


def sanitised(text: Column) -> Column:
    """Control characters removed, ends stripped."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"(?U)^\s+|\s+$", "")


def escaped(text: Column) -> Column:
    """Scripts removed, HTML characters escaped."""
    out = F.regexp_replace(text, r"(?is)<script\b.*?</script\s*>", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def wrapped_evidence(evidence_id: Column, title: Column, text: Column) -> Column:
    """A passage inside boundaries that say it is data, with a warning if it reads like an instruction."""
    from evidara.operators.gates import injections

    clean = sanitised(text)
    found = injections(clean)
    warning = F.when(F.size(found) > 0, F.concat(F.lit("<!-- WARNING: Adversarial markers detected: "), F.array_join(found, ", "), F.lit(" -->\n"))).otherwise(F.lit(""))
    return F.concat(F.lit('<untrusted_legal_evidence id="'), evidence_id, F.lit('" title="'), title, F.lit('">\n'), warning, clean, F.lit("\n</untrusted_legal_evidence>"))


def contextual_header(publisher: Column, title: Column, version: Column, periods: Column, path: Column, source_class: Column, citation: Column) -> Column:
    """Bracketed lines that make a chunk readable by itself."""
    said = lambda c, other: F.coalesce(F.nullif(c, nothing()), F.lit(other))
    kept = F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda p: F.coalesce(p, nothing()) != "")
    heading = F.coalesce(F.nullif(F.array_join(kept, " > "), nothing()), title, nothing())
    lines = [
        F.lit("[JURISDICTION: Commonwealth of Australia]"),
        F.concat(F.lit("[SOURCE: "), said(publisher, "Unknown"), F.lit("]")),
        F.concat(F.lit("[DOCUMENT: "), said(title, "Untitled"), F.lit("]")),
        F.concat(F.lit("[VERSION: "), said(version, "unknown"), F.lit("]")),
        F.concat(F.lit("[APPLICABLE-PERIOD: "), said(F.array_join(periods, ", "), "not specified"), F.lit("]")),
        F.concat(F.lit("[PATH: "), heading, F.lit("]")),
        F.concat(F.lit("[AUTHORITY: "), said(source_class, "unknown"), F.lit("]")),
        F.when(F.coalesce(citation, nothing()) != "", F.concat(F.lit("[CITATION: "), citation, F.lit("]"))),
    ]
    return F.concat_ws("\n", *lines)
