"""Answers over evidence: extraction, adequacy, citations, validation, judging. Rows are one query each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import fixed
from evidara.functions.text import identifiers, normal_identifier, term_set

EVIDENCE = "array<struct<evidence_id:string,document_id:string,version_id:string,parent_id:string,citation_label:string,title:string,source_url:string,section_id:string,retrieval_reason:string,reranker_score:double,text:string>>"
CLAIMS = "array<struct<claim_id:string,text:string,evidence_ids:array<string>>>"


def extracted_claims(evidence: Column) -> Column:
    """A claim from each of the first four units: its first sentence of over 30 characters, else its first 200 characters."""

    def claim(u: Column, k: Column) -> Column:
        sentences = F.filter(F.split(F.trim(u["text"]), r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 30)
        text = F.coalesce(F.trim(F.get(sentences, F.lit(0))), F.substring(F.trim(u["text"]), 1, 200))
        return F.struct(F.format_string("c%d", k + 1).alias("claim_id"), text.alias("text"), F.array(u["evidence_id"]).alias("evidence_ids"))

    return F.transform(F.slice(evidence, 1, 4), claim)


def rendered(claims: Column, none: str = "The available evidence does not answer the question.") -> Column:
    lines = F.transform(claims, lambda c: F.concat(c["text"], F.lit(" ["), F.array_join(c["evidence_ids"], ", "), F.lit("]")))
    return F.when(F.size(claims) > 0, F.array_join(lines, " ")).otherwise(F.lit(none))


def repaired(limitations: Column, errors: Column) -> Column:
    """Unresolved errors become limitations; claims stay."""
    return F.concat(limitations, F.transform(errors, lambda e: F.concat(F.lit("Unresolved: "), e)))


def rewritten(query: Column) -> Column:
    """The query without conversational words, or the query if nothing is left."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: ~F.lower(w).isin(fixed.STOP_WORDS) & (w != ""))
    return F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), query)


def adequacy(query: Column, evidence: Column) -> Column:
    """ADEQUATE, WEAK or INADEQUATE by the first rule that decides."""
    q = F.trim(query)
    asked = identifiers(q)
    labels = F.flatten(F.transform(evidence, lambda u: F.array(u["citation_label"], u["title"], u["section_id"])))
    labels = F.filter(labels, lambda x: F.coalesce(x, F.lit("")) != "")
    known = F.flatten(F.transform(labels, lambda x: F.concat(F.array(normal_identifier(x)), identifiers(x))))
    words = F.filter(F.regexp_extract_all(F.lower(q), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(fixed.STOP_WORDS) & (F.length(w) > 2))
    corpus = F.lower(F.array_join(F.transform(evidence, lambda u: u["text"]), " "))
    coverage = F.size(F.filter(words, lambda w: corpus.contains(w))) / F.size(words)

    def agrees(u: Column) -> Column:
        channels = F.array_distinct(F.filter(F.split(u["retrieval_reason"], r"\+"), lambda c: (c != "") & (c != "reranker")))
        return (F.size(channels) >= 2) & F.arrays_overlap(channels, F.array(F.lit("exact"), F.lit("lexical")))

    agreement = F.exists(evidence, agrees)
    best = F.coalesce(F.array_max(F.transform(evidence, lambda u: u["reranker_score"])), F.lit(0.0))
    return (
        F.when(F.size(evidence) <= 0, "INADEQUATE")
        .when(q.rlike(fixed.FOREIGN_QUERY) | q.rlike(fixed.SPECULATIVE_QUERY), "INADEQUATE")
        .when(F.size(asked) > 0, F.when(F.size(F.array_except(asked, known)) == 0, "ADEQUATE").otherwise("INADEQUATE"))
        .when(F.size(words) == 0, "INADEQUATE")
        .when(agreement & (best >= 0.70), "ADEQUATE")
        .when((coverage < 0.35) & ~agreement, "INADEQUATE")
        .when((coverage < 0.50) & (best < 0.15), "WEAK")
        .otherwise("ADEQUATE")
    )


def validation(markdown: Column, claims: Column, evidence: Column) -> Column:
    """struct(errors, evidence_state) of an answer against its evidence."""
    ids = F.transform(evidence, lambda u: u["evidence_id"])
    claim_ids = F.transform(claims, lambda c: c["claim_id"])
    used = F.flatten(F.transform(claims, lambda c: c["evidence_ids"]))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    unit = lambda e: F.get(F.filter(evidence, lambda u: u["evidence_id"] == e), F.lit(0))

    def of_id(c: Column, e: Column) -> Column:
        u = unit(e)
        return F.when(~F.array_contains(ids, e), F.array(F.concat(F.lit("Claim "), c["claim_id"], F.lit(" references unsupplied evidence ID: "), e))).otherwise(
            F.concat(
                F.when(blank(u["source_url"]) | blank(u["parent_id"]), F.array(F.concat(F.lit("Evidence "), e, F.lit(" lacks a source URL or parent.")))).otherwise(F.array()),
                F.when(blank(u["document_id"]) | blank(u["version_id"]), F.array(F.concat(F.lit("Evidence "), e, F.lit(" lacks a document or version.")))).otherwise(F.array()),
            )
        )

    def of_claim(c: Column) -> Column:
        return F.concat(
            F.when(blank(c["text"]), F.array(F.concat(F.lit("Claim "), c["claim_id"], F.lit(" is empty.")))).otherwise(F.array()),
            F.when(F.size(c["evidence_ids"]) <= 0, F.array(F.concat(F.lit("Claim "), c["claim_id"], F.lit(" lacks evidence IDs.")))).otherwise(F.array()),
            F.flatten(F.transform(c["evidence_ids"], lambda e: of_id(c, e))),
        )

    whole = F.filter(
        F.array(
            F.when(blank(markdown), "The answer is empty."),
            F.when(F.size(claims) <= 0, "The answer has no claims."),
            F.when(F.size(F.array_distinct(ids)) < F.size(ids), "Evidence IDs repeat."),
            F.when(F.exists(claim_ids, blank) | (F.size(F.array_distinct(claim_ids)) < F.size(claim_ids)), "Claim IDs must be non-empty and unique."),
            F.when((F.size(ids) == 0) & (F.size(claims) > 0), "Claims were made without evidence."),
        ),
        lambda e: e.isNotNull(),
    )
    errors = F.concat(whole, F.flatten(F.transform(claims, of_claim)))
    state = (
        F.when((F.size(evidence) <= 0) | (F.size(claims) <= 0) & (F.size(errors) == 0), "INSUFFICIENT_EVIDENCE")
        .when(F.size(errors) == 0, "SUPPORTED")
        .when(F.arrays_overlap(used, ids), "PARTIALLY_SUPPORTED")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )
    return F.struct(errors.alias("errors"), state.alias("evidence_state"))


def citations(answers: DataFrame) -> DataFrame:
    """(query_id, citation_id, evidence_id, document_id, display): used evidence that was supplied, each once, numbered by its first use."""
    used = answers.select("query_id", F.posexplode(F.flatten(F.transform("claims", lambda c: c["evidence_ids"]))).alias("k", "evidence_id"))
    first = used.groupBy("query_id", "evidence_id").agg((F.min("k") + 1).alias("k"))
    units = answers.select("query_id", F.explode("evidence").alias("u")).select("query_id", "u.*")
    return first.join(units, ["query_id", "evidence_id"]).select("query_id", F.format_string("cit_%02d", "k").alias("citation_id"), "evidence_id", "document_id", F.coalesce(F.nullif("citation_label", F.lit("")), "title").alias("display"))


def judged(query: Column, markdown: Column, claims: Column, limitations: Column, evidence: Column) -> Column:
    """struct(evidence_support, answer_completeness, relevance, unsupported_claim_risk, overall): a lexical proxy."""
    asked = term_set(query)
    relevance = F.least(F.lit(1.0), F.size(F.array_intersect(asked, term_set(markdown))) / F.greatest(F.lit(1), F.size(asked)))

    def support(c: Column, e: Column) -> Column:
        text = F.lower(F.get(F.filter(evidence, lambda u: u["evidence_id"] == e), F.lit(0))["text"])
        terms, held = term_set(c["text"]), term_set(text)
        hits = F.size(F.filter(terms, lambda w: F.array_contains(held, w) | (F.length(w) >= 4) & text.contains(F.substring(w, 1, 4))))
        return F.when(text.isNull(), 0.0).otherwise(F.least(F.lit(1.0), hits / F.greatest(F.lit(1), F.size(terms)) * 1.5))

    scores = F.transform(claims, lambda c: F.coalesce(F.array_max(F.transform(c["evidence_ids"], lambda e: support(c, e))), F.lit(0.0)))
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, b: a + b) / F.size(scores)).otherwise(0.5)
    bare = F.size(evidence) <= 0
    s = F.when(bare, 1.0).otherwise(F.round(mean, 4))
    comp = F.when(bare, 1.0).when((F.size(limitations) > 0) & (F.size(claims) >= 1), 0.95).otherwise(0.70)
    rel = F.when(bare, F.when(F.size(claims) <= 0, 1.0).otherwise(0.5)).otherwise(F.round(relevance, 4))
    risk = F.when(bare, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - mean), 4))
    overall = 0.40 * s + 0.30 * comp + 0.20 * rel + 0.10 * (1 - risk)
    return F.struct(s.alias("evidence_support"), comp.alias("answer_completeness"), rel.alias("relevance"), risk.alias("unsupported_claim_risk"), F.round(overall, 4).alias("overall"))


def prompt(query: Column, evidence: Column) -> Column:
    """The question and the evidence, a headed block for each unit."""
    block = lambda u: F.concat(F.lit("["), u["evidence_id"], F.lit("] "), F.coalesce(F.nullif(u["citation_label"], F.lit("")), u["title"]), F.lit("\n"), u["text"])
    return F.concat_ws("\n\n", F.concat(F.lit("Question: "), query), F.array_join(F.transform(evidence, block), "\n\n"))


def answer_faults(payload: Column) -> Column:
    """What keeps a generated payload (JSON) from being an answer: not JSON, missing or unknown keys."""
    keys = ["answer_markdown", "claims", "limitations", "needs_human_review"]
    have = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    want = F.array(*map(F.lit, keys))
    found = F.array(F.when(F.try_parse_json(payload).isNull(), "not JSON"), F.when(F.size(F.array_except(want, have)) > 0, F.concat(F.lit("missing "), F.array_join(F.array_except(want, have), ", "))), F.when(F.size(F.array_except(have, want)) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_except(have, want), ", "))))
    return F.filter(found, lambda x: x.isNotNull())
