"""URL filtering by rules and by link-graph propagation (operator 5), DataFrame functions only.

A url's rule is the longest rule that fits; other urls get their host's verdict. Host edges
are the links of the pages to other hosts. Trust is a personalised PageRank over the edges,
restarted at the hosts of pages that a rule allows; distrust is one over the reversed edges,
restarted at the hosts of pages that a rule blocks. Each passes a host's score on in shares that
add up to one: trust by the links that a host gives, distrust by those that it gets. A host is
blocked where its distrust exceeds ``threshold`` times its trust; a host that neither reaches, or
that both reach alike, is allowed. Walks go on until what is still under way cannot add
``TOLERANCE`` to any host's score.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
there up to ``?``, ``#`` or the end. A null url or one without ``://`` has an empty host and path
and can have no rule. Null html has no links; urls and html count whole, however long. Every row of
the input gives one row, repeated ones too (their links count as often); without rows the result is
empty, and with no seeds all hosts are allowed. Only page_id, url and html are read, whatever other
columns there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import checkpointed

#: (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DAMPING, THRESHOLD = 0.85, 1.0
#: Rounds between two checkpoints, each with a test of convergence.
ROUNDS = 6
TOLERANCE, PLACES = 1e-9, 8

#: Blocked hosts that are sent to all tasks; more of them are joined, in SALTS copies so that no host's pages meet in one task.
BLOCKED_HOSTS, SALTS = 200_000, 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\shref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): the links of a host to others."""
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    return links.select(F.col("host").alias("src"), F.translate("to", UPPER, LOWER).alias("dst")).where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def shared_out(links: DataFrame) -> DataFrame:
    """(src, dst, w): the share of a source's links that goes to each of its targets."""
    total = links.groupBy("src").agg(F.sum("n").alias("total"))
    return links.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("w"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, score) of a PageRank restarted at seeds (host, share), converged; mass at hosts without edges leaves the graph.

    A round moves each host's last gain along the edges, so the gains' sum shrinks by damping at least: no
    host can get more than that sum times damping / (1 - damping), and that is what must fall under tolerance.
    """
    state = seeds.select("host", ((1 - damping) * F.col("share")).alias("score"), ((1 - damping) * F.col("share")).alias("gain"))
    while True:
        for _ in range(ROUNDS):
            moved = state.where("gain > 0").join(edges, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("gain") * F.col("w"))).alias("gain"))
            kept = state.select("host", "score", F.lit(0.0).alias("gain"))
            state = kept.unionByName(moved.select("host", F.col("gain").alias("score"), "gain")).groupBy("host").agg(F.sum("score").alias("score"), F.sum("gain").alias("gain"))
        state = checkpointed(state)
        left = state.agg(F.sum("gain")).first()[0] or 0.0
        if left * damping < tolerance * (1 - damping):
            return state.select("host", "score")


def scores(seeds: DataFrame, links: DataFrame, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of all hosts that either reaches; seeds: (host, verdict, n)."""
    total = {r.verdict: r.n for r in seeds.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}  # two rows
    # both at once, as walks on two graphs that do not meet
    tagged = lambda tag, *cols: [F.concat(F.lit(tag), c).alias(name) for c, name in cols]
    sides = (("+", "allow", links), ("-", "block", links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")))
    restarts = [seeds.where(F.col("verdict") == v).select(*tagged(tag, ("host", "host")), (F.col("n") / total.get(v, 1)).alias("share")) for tag, v, _ in sides]
    ways = [shared_out(x).select(*tagged(tag, ("src", "src"), ("dst", "dst")), "w") for tag, _, x in sides]
    found = propagate(restarts[0].unionByName(restarts[1]), checkpointed(ways[0].unionByName(ways[1])), damping)
    side = lambda tag: F.sum(F.when(F.col("host").startswith(tag), F.col("score")).otherwise(0.0))
    return found.groupBy(F.expr("substring(host, 2)").alias("host")).agg(side("+").alias("trust"), side("-").alias("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, damping: float = DAMPING, threshold: float = THRESHOLD, most_sent: int = BLOCKED_HOSTS) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"), longest_rule(host, path, rules or RULES).alias("r"), "html")
    ruled = named.select("page_id", "host", "path", "r.rule", "r.verdict")
    seeds = checkpointed(ruled.where("verdict is not null").groupBy("host", "verdict").agg(F.count(F.lit(1)).alias("n")))
    scored = scores(seeds, checkpointed(host_links(named)), damping)
    blocked = scored.where(F.round("distrust", PLACES) > F.round(threshold * F.col("trust"), PLACES)).select("host", F.lit("block").alias("judged"))
    blocked = checkpointed(blocked)
    if blocked.count() <= most_sent:
        found = ruled.join(F.broadcast(blocked), "host", "left")
    else:
        copies = blocked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = ruled.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(copies, ["host", "salt"], "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("verdict", "judged", F.lit("allow")).alias("verdict"))


def oracle_sql() -> str:
    rules = "\n".join(
        f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p} {v}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    rounds = math.ceil(math.log(TOLERANCE * (1 - DAMPING)) / math.log(DAMPING))
    steps = []
    for name, verdict, src, dst in (("t", "allow", "src", "dst"), ("d", "block", "dst", "src")):
        steps.append(
            f"{name}w AS (SELECT {src} AS a, {dst} AS b, n / sum(n) OVER (PARTITION BY {src}) AS w FROM c),\n"
            f"{name}g AS (SELECT 0 AS k, host, {1 - DAMPING} * count(*) / sum(count(*)) OVER () AS gain FROM u WHERE verdict = '{verdict}' GROUP BY host\n"
            f"  UNION ALL SELECT g.k + 1, b, {DAMPING} * sum(gain * w) FROM {name}g g JOIN {name}w ON a = host WHERE g.k < {rounds} GROUP BY g.k, b),\n"
            f"{name} AS (SELECT host, sum(gain) AS score FROM {name}g GROUP BY host)"
        )
    steps = ",\n".join(steps)
    return f"""
WITH RECURSIVE p AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT *, CASE
{rules}
    END AS fit FROM p),
u AS (SELECT page_id, host, path, split_part(fit, ' ', 1) AS rule, split_part(fit, ' ', 2) AS verdict FROM m),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)), '{UPPER}', '{LOWER}') AS dst FROM p),
c AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND src <> '' GROUP BY ALL),
{steps}
SELECT page_id, host, path, rule, coalesce(verdict,
  CASE WHEN round(coalesce(d.score, 0), {PLACES}) > round({THRESHOLD} * coalesce(t.score, 0), {PLACES}) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN t USING (host) LEFT JOIN d USING (host)
"""
