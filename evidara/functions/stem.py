"""English stems by the published suffix rules (Porter's second algorithm), as SQL expressions.

Each step is one expression over the word so far and the places where its two regions start. The same
rules give the text for Spark and that of the SQL which results are held against; only regular
expression calls are spelled differently. Letters outside English count as consonants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import fixed

VOWEL, OTHER = "[aeiouy]", "[^aeiouy]"
TO_REGION = f"^{OTHER}*{VOWEL}+{OTHER}"
SHORT_END = f"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$"


def _quoted(text: str) -> str:
    return "'" + text + "'"


class Spelling:
    """How an engine writes what the rules need."""

    def __init__(self, spark: bool):
        self.spark = spark

    def like(self, w: str, pattern: str) -> str:
        escaped = pattern.replace(chr(92), chr(92) * 2)  # as Spark's literals want it
        return f"({w} RLIKE {_quoted(escaped)})" if self.spark else f"regexp_matches({w}, {_quoted(pattern)})"

    def replaced(self, w: str, pattern: str, by: str) -> str:
        return f"regexp_replace({w}, {_quoted(pattern)}, {_quoted(by)})" if self.spark else f"regexp_replace({w}, {_quoted(pattern)}, {_quoted(by.replace('$', chr(92)))}, 'g')"


def _cut(w: str, n: int, more: str = "") -> str:
    cut = f"substr({w}, 1, length({w}) - {n})"
    return f"({cut} || '{more}')" if more else cut


def _first(cases: list[tuple[str, str]], w: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {then}" for test, then in cases) + f" ELSE {w} END"


def _suffixes(w: str, rules: dict[str, str], region: str, more: dict[str, str] | None = None) -> str:
    """The longest suffix found decides; it is replaced if it lies in the region, and if a further test holds."""
    cases = []
    for suffix in sorted(rules, key=lambda s: (-len(s), s)):
        test = f"{region} <= length({w}) - {len(suffix)}" + (f" AND {more[suffix]}" if more and suffix in more else "")
        cases.append((f"{w} LIKE '%{suffix}'", f"CASE WHEN {test} THEN {_cut(w, len(suffix), rules[suffix])} ELSE {w} END"))
    return _first(cases, w)


def steps(spark: bool, of: str = "") -> list[tuple[str, str]]:
    """(name, expression) in order; w starts as the lower-cased word, w0 keeps it; `of` stands before each name that is read."""
    s, w, w0, r1, r2, u, done = Spelling(spark), *(of + name for name in ("w", "w0", "r1", "r2", "u", "done"))
    region = f"length(regexp_extract({{}}, {_quoted(TO_REGION)}, 0))"
    special = f"length(regexp_extract({w}, {_quoted('^(' + '|'.join(fixed.STEM_PREFIXES) + ')')}, 0))"
    rest = region.format(f"substr({w}, {r1} + 1)")
    double = "(" + "|".join(c * 2 for c in "bdfgmnprt") + ")$"
    past = _first(
        [
            (done, w),
            (f"{w} LIKE '%eedly'", f"CASE WHEN {r1} <= length({w}) - 5 THEN {_cut(w, 3)} ELSE {w} END"),
            (f"{w} LIKE '%eed'", f"CASE WHEN {r1} <= length({w}) - 3 THEN {_cut(w, 1)} ELSE {w} END"),
            (f"{u} IS NULL", w),
            (s.like(u, "(at|bl|iz)$"), f"({u} || 'e')"),
            (s.like(u, double), _cut(u, 1)),
            (f"{r1} >= length({u}) AND {s.like(u, SHORT_END)}", f"({u} || 'e')"),
        ],
        u,
    )
    last_e = f"{w} LIKE '%e' AND ({r2} <= length({w}) - 1 OR {r1} <= length({w}) - 1 AND NOT {s.like(_cut(w, 1), SHORT_END)})"
    return [
        ("w", s.replaced(s.replaced(w, "^y", "Y"), "([aeiouy])y", "$1Y")),
        ("r1", f"CASE WHEN {special} > 0 THEN {special} WHEN {region.format(w)} > 0 THEN {region.format(w)} ELSE length({w}) END"),
        ("r2", f"CASE WHEN {rest} > 0 THEN {r1} + {rest} ELSE length({w}) END"),
        ("w", _first([(f"{w} LIKE '%sses'", _cut(w, 2)), (s.like(w, "ie[ds]$"), f"CASE WHEN length({w}) > 4 THEN {_cut(w, 2)} ELSE {_cut(w, 1)} END"), (s.like(w, "(us|ss)$"), w), (s.like(w, f"{VOWEL}.+s$"), _cut(w, 1))], w)),
        ("done", f"{w} IN ({', '.join(map(_quoted, fixed.STEM_KEPT_AFTER_PLURAL))})"),
        ("u", f"CASE WHEN {s.like(w, '(eed|eedly)$')} THEN NULL WHEN {s.like(w, VOWEL + '.*(ingly|edly|ing|ed)$')} THEN {s.replaced(w, '(ingly|edly|ing|ed)$', '')} END"),
        ("w", past),
        ("w", _first([(f"NOT {done} AND {s.like(w, f'^.+{OTHER}[yY]$')}", _cut(w, 1, "i"))], w)),
        ("w", _first([(done, w)], _suffixes(w, fixed.STEM_SECOND, r1, {"ogi": f"{w} LIKE '%logi'", "li": s.like(w, "[cdeghkmnrt]li$")}))),
        ("w", _first([(done, w)], _suffixes(w, fixed.STEM_THIRD, r1, {"ative": f"{r2} <= length({w}) - 5"}))),
        ("w", _first([(done, w)], _suffixes(w, dict.fromkeys(fixed.STEM_FOURTH, ""), r2, {"ion": s.like(w, "[st]ion$")}))),
        ("w", _first([(done, w), (last_e, _cut(w, 1)), (f"{w} LIKE '%ll' AND {r2} <= length({w}) - 1", _cut(w, 1))], w)),
        ("stem", "CASE " + " ".join(f"WHEN {w0} = '{a}' THEN '{b}'" for a, b in fixed.STEM_EXCEPTIONS.items()) + f" WHEN length({w0}) < 3 OR NOT {s.like(w0, WORD)} THEN {w0} ELSE {s.replaced(w, 'Y', 'y')} END"),
    ]


#: Words with digits are terms as they are.
WORD = r"^\p{L}+$"


def stem(word: str) -> Column:
    """The stem of a lower-cased word in a column. Each step reads the last one's struct by name, so the expression grows by a step and no more."""
    expression, names = f"array(named_struct('w0', {word}, 'w', {word}))", ["w0", "w"]
    for name, then in steps(True, "s."):
        names += [name] * (name not in names)
        expression = f"transform({expression}, s -> named_struct({', '.join(f'{_quoted(n)}, {then if n == name else "s." + n}' for n in names)}))"
    return F.expr(f"coalesce(element_at({expression}, 1).stem, '')")


def with_stems(words: DataFrame, word: str = "word") -> DataFrame:
    """words with a column stem; meant for a table of distinct words, as rules cost more than a lookup."""
    return words.withColumn("stem", stem(word))


def stems_sql(words: str, word: str = "word") -> str:
    """A subquery (word, stem) over a subquery of distinct words."""
    out = f"SELECT {word} AS w0, {word} AS w FROM ({words})"
    for name, expression in steps(False):
        out = f"SELECT * REPLACE ({expression} AS w) FROM ({out})" if name == "w" else f"SELECT *, {expression} AS {name} FROM ({out})"
    return f"SELECT w0 AS {word}, stem FROM ({out})"
