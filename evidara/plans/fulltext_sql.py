"""The SQL that full-text search is held against."""

from __future__ import annotations

from evidara.functions import fixed
from evidara.functions.stem import stems_sql
from evidara.operators import fulltext
from evidara.plans.registry import quoted

_STOP = "[" + ", ".join(map(quoted, fixed.SEARCH_STOP_WORDS)) + "]"


def matches_sql(queries: str, chunks: str) -> str:
    """(query_id, chunk_id, score) for queries (query_id, query) and chunks (chunk_id, text): terms by joins, covers by the latest start before each end."""
    words = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), {quoted(fulltext.TERM)})"
    return f"""
WITH fp AS (SELECT query_id, unnest(s) AS said, unnest(range(len(s))) AS part FROM (SELECT query_id, regexp_extract_all(coalesce(query, ''), {quoted(fulltext.PART)}) AS s FROM ({queries}))),
fo AS (SELECT *, count(*) FILTER (lower(said) = 'or') OVER (PARTITION BY query_id ORDER BY part) AS alternative FROM fp),
ft AS (SELECT query_id, alternative, part, starts_with(said, '-') AS excluded, unnest(w) AS word, unnest(range(len(w))) AS place FROM (SELECT *, {words("said")} AS w FROM fo WHERE lower(said) <> 'or')),
fs AS (SELECT * FROM ft WHERE NOT list_contains({_STOP}, word)),
fd AS MATERIALIZED (SELECT chunk_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM (SELECT chunk_id, {words("text")} AS w FROM ({chunks}))),
fw AS MATERIALIZED ({stems_sql("SELECT word FROM fd UNION SELECT word FROM fs")}),
fa AS MATERIALIZED (SELECT query_id, alternative, part, excluded, place, stem FROM fs JOIN fw USING (word)),
fc AS (SELECT query_id, alternative, part, excluded, count(*) AS n, min(place) AS a, max(place) AS b FROM fa GROUP BY ALL),
fk AS (SELECT query_id, alternative, count(*) FILTER (NOT excluded) AS needed FROM fc GROUP BY ALL),
fh AS MATERIALIZED (SELECT a.query_id, d.chunk_id, d.place, w.stem FROM fd d JOIN fw w USING (word) JOIN (SELECT DISTINCT query_id, stem FROM fa) a USING (stem)),
fx AS MATERIALIZED (SELECT h.query_id, h.chunk_id, c.alternative, c.part, c.excluded, h.place - a.place + c.a AS p, h.place - a.place + c.b AS q FROM fh h JOIN fa a USING (query_id, stem) JOIN fc c ON c.query_id = a.query_id AND c.part = a.part GROUP BY h.query_id, h.chunk_id, c.alternative, c.part, c.excluded, h.place - a.place, c.a, c.b, c.n HAVING count(*) = c.n),
fm AS (SELECT query_id, chunk_id, alternative FROM (SELECT DISTINCT query_id, chunk_id, alternative, part, excluded FROM fx) JOIN fk USING (query_id, alternative) GROUP BY query_id, chunk_id, alternative, needed HAVING count(*) FILTER (excluded) = 0 AND count(*) FILTER (NOT excluded) = needed),
fy AS MATERIALIZED (SELECT x.* FROM fx x JOIN fm USING (query_id, chunk_id, alternative) WHERE NOT excluded),
fl AS (SELECT e.query_id, e.chunk_id, e.q, x.alternative, x.part, max(x.p) AS p FROM (SELECT DISTINCT query_id, chunk_id, q FROM fy) e JOIN fy x ON x.query_id = e.query_id AND x.chunk_id = e.chunk_id AND x.q <= e.q GROUP BY ALL),
fg AS (SELECT query_id, chunk_id, q, alternative, min(p) AS p FROM fl JOIN fk USING (query_id, alternative) GROUP BY query_id, chunk_id, q, alternative, needed HAVING count(*) = needed),
fz AS (SELECT query_id, chunk_id, p, min(q) AS q FROM (SELECT query_id, chunk_id, q, max(p) AS p FROM fg GROUP BY ALL) GROUP BY query_id, chunk_id, p),
fn AS (SELECT z.query_id, z.chunk_id, z.p, z.q, count(*) AS held FROM fz z JOIN fh h ON h.query_id = z.query_id AND h.chunk_id = z.chunk_id AND h.place BETWEEN z.p AND z.q GROUP BY ALL)
SELECT query_id, chunk_id, sum(0.1::DOUBLE / (2 + q - p - held)) AS score FROM fn GROUP BY ALL"""


def search_sql(queries: str, chunks: str, k: int = fixed.LEXICAL_LIMIT) -> str:
    """(query_id, chunk_id, score, rank) for chunks (chunk_id, text, authority_rank, is_active)."""
    return f"""
SELECT query_id, chunk_id, score, rank FROM (SELECT m.query_id, m.chunk_id, m.score, row_number() OVER (PARTITION BY m.query_id ORDER BY round(m.score, 9) DESC, c.authority_rank ASC NULLS LAST, m.chunk_id) AS rank
  FROM ({matches_sql(queries, f"SELECT chunk_id, text FROM ({chunks}) WHERE is_active")}) m JOIN ({chunks}) c USING (chunk_id)) WHERE rank <= {k}"""
