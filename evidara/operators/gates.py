"""Gates before retrieval: policy, scope, tenants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import fixed


def injections(text: Column) -> Column:
    """What matched of the injection patterns, one match each."""
    found = F.array(*(F.regexp_extract(text, p, 0) for p in fixed.INJECTION_PATTERNS))
    return F.filter(found, lambda x: x != "")


def policy_code(query: Column) -> Column:
    """The first gate that a query fails, or POLICY_PASSED."""
    q = F.trim(query)
    readable = F.length(F.regexp_replace(q, r"[^\p{L}\p{N}]", "")) / F.greatest(F.lit(1), F.length(q))
    gate = F.when(~F.lower(q).rlike("[a-z]{2,}") | (readable < 0.35), "MALFORMED_INPUT").when(q.rlike(fixed.MALFORMED_PATTERN), "MALFORMED_SYNTAX")
    gate = gate.when(F.size(injections(q)) > 0, "PROMPT_INJECTION")
    for p in fixed.EVASION_PATTERNS:
        gate = gate.when(q.rlike(p), "TAX_EVASION_REFUSAL")
    return gate.otherwise("POLICY_PASSED")


def scope_decision(query: Column) -> Column:
    """struct(status, code, domain)"""
    q = F.trim(query)
    said = lambda s, c, d: F.struct(F.lit(s).alias("status"), F.lit(c).alias("code"), F.lit(d).alias("domain"))
    out = None
    for k, (domain, pattern) in enumerate(fixed.OUTSIDE_DOMAINS):
        value = said("OUT_OF_CORPUS", "NEAR_DOMAIN_UNINDEXED" if k else "FOREIGN_LAW", domain)
        out = F.when(q.rlike(pattern), value) if out is None else out.when(q.rlike(pattern), value)
    out = out.when(q.rlike(fixed.IN_SCOPE_PATTERN), said("IN_SCOPE", "IN_SCOPE_TAX_CORPUS", "australian_taxation"))
    return out.otherwise(said("AMBIGUOUS_SCOPE", "AMBIGUOUS_LEGAL_SCOPE", "ambiguous_australian_law"))


def tenant_rows(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """A tenant's rows; no rows where no tenant is set."""
    return df.where(F.col(column) == F.nullif(F.lit(tenant).cast("string"), F.lit("")))


@dataclass(frozen=True)
class Scope:
    """Who asks, and for which matter and classifications."""

    tenant: str | None
    matters: frozenset[str] = frozenset()
    classifications: frozenset[str] = frozenset(fixed.PUBLIC_CLASSIFICATIONS)


class ScopeError(PermissionError):
    pass


def enforced(df: DataFrame, scope: Scope | None, matter: str | None = None) -> DataFrame:
    """Refuses before planning what the scope does not cover, then filters by tenant, matter and classification."""
    if scope is None or not scope.tenant:
        raise ScopeError("no tenant is set")
    if matter is not None and matter not in scope.matters:
        raise ScopeError("the matter is not the tenant's")
    rows = tenant_rows(df, scope.tenant).where(F.col("classification").isin(sorted(scope.classifications)))
    return rows if matter is None else rows.where(F.col("matter_id") == matter)
