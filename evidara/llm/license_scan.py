"""License scans by template markup (operator 13).

A template is wording with regions: ``<<beginOptional>> ... <<endOptional>>`` may be there or not and may
be nested, ``<<var;name=holder;words=0..60>>`` stands for so many words of any kind. All other words are
mandatory and have to match exactly, A-Z lower-cased. The templates are compiled into one token
automaton whose states are sets of places in templates, made as texts reach them. It starts at every
word that can begin a template and goes on, for all of these places of a chunk at once, until
it has nowhere to go; a place's longest acceptance counts, once per template.

Words are runs of letters, digits and characters outside ASCII. Matches do not cross documents. The
score of a document is 1 - 1 / (1 + n), n being the mandatory words of the longest template found;
without any it is 0.

Nulls: a null text has no words, a null doc_id stays null. Empty texts and texts without words have
no matches and null places. Texts of any length are read whole, piece by piece, and matched across
pieces. Ties: a place that several templates accept counts for each of them. Repeated rows give a
row each, empty tables none. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.common import CHUNK_BYTES, Batches, as_bytes, emit, small_batches
from evidara.llm.words import Vocabulary, word_chunks, word_ranges


class Template(NamedTuple):
    label: str
    wording: str
    base: bool = False


# Phrases and labels of the contract, then published license notices and texts with their replaceable parts marked.
TEMPLATES = (
    Template("mit", "MIT License", True),
    Template("apache", "Apache License", True),
    Template("gpl", "General Public License", True),
    Template("apache-2.0", "Apache License <<beginOptional>>Version<<endOptional>> 2.0"),
    Template("gpl-2.0", "<<beginOptional>>GNU<<endOptional>> General Public License <<beginOptional>>as published by the Free Software Foundation <<beginOptional>>either<<endOptional>><<endOptional>> version 2"),
    Template("gpl-3.0", "<<beginOptional>>GNU<<endOptional>> General Public License <<beginOptional>>as published by the Free Software Foundation <<beginOptional>>either<<endOptional>><<endOptional>> version 3"),
    Template("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY 4.0"),
    Template("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC 4.0"),
    Template("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 <<beginOptional>>International<<endOptional>> <<beginOptional>>Public<<endOptional>> License"),
    Template("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=software;words=2..6>> and associated documentation files (the "Software"), to deal in the Software
        without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name=holder;words=1..30>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"""),
    Template("isc-text", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=author;words=1..20>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"""),
    Template("bsd-text", """Redistribution and use in source and binary forms, with or without modification, are permitted <<beginOptional>>(subject to the limitations in the disclaimer below)<<endOptional>> provided that the
        following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. <<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of <<var;name=organization;words=1..20>> nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.<<endOptional>> THIS SOFTWARE IS PROVIDED BY <<var;name=holder;words=1..20>> "AS IS\""""),
)

#: Words and regions of a lower-cased template.
_PART = re.compile(r"<<(beginoptional|endoptional)[^>]*>>|<<var;[^>]*?words=(\d+)\.\.(\d+)[^>]*>>|([0-9a-z\u0080-\U0010ffff]+)")

#: Places at which the automaton starts at once, and the states it may have before it is made anew.
STARTS, STATES = 1_000_000, 20_000


def _lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def parsed(wording: str) -> list:
    """Words as strings, replaceable regions as (least, most), optional regions as lists."""
    stack: list[list] = [[]]
    rest = _lower(wording)
    if "<<" in _PART.sub(" ", rest):
        raise ValueError(f"no such markup: {wording}")
    for m in _PART.finditer(rest):
        if m[1] == "beginoptional":
            stack.append([])
        elif m[1]:
            if len(stack) < 2:
                raise ValueError(f"an optional region ends that did not begin: {wording}")
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            stack[-1].append((int(m[2]), int(m[3])) if m[2] else m[4])
    if len(stack) > 1:
        raise ValueError(f"an optional region does not end: {wording}")
    if not any(isinstance(p, str) for p in stack[0]) or isinstance(stack[0][0], tuple) or isinstance(stack[0][-1], tuple):
        raise ValueError(f"a template has mandatory words and neither begins nor ends with a replaceable region: {wording}")
    return stack[0]


def mandatory(template: Template) -> int:
    """Words that every match has."""
    return sum(1 if isinstance(p, str) else p[0] if isinstance(p, tuple) else 0 for p in parsed(template.wording))


class Automaton:
    """Symbols are numbers of template words; then one for any other word, and one for the end of a document."""

    def __init__(self, templates: tuple[Template, ...]):
        plans = [parsed(t.wording) for t in templates]
        words: dict[str, int] = {}

        def collect(parts: list) -> None:
            for p in parts:
                if isinstance(p, str):
                    words.setdefault(p, len(words))
                elif isinstance(p, list):
                    collect(p)

        for plan in plans:
            collect(plan)
        self.vocabulary = Vocabulary([w.encode() for w in words])
        self.other, self.end = len(words), len(words) + 1
        self.by_word: list[dict[int, int]] = []  # of each place: symbol -> place
        self.by_any: list[int] = []
        self.free: list[list[int]] = []  # places reached without reading
        self.accepts: dict[int, int] = {}

        def place() -> int:
            self.by_word.append({})
            self.by_any.append(-1)
            self.free.append([])
            return len(self.free) - 1

        def lay(parts: list, at: int) -> int:
            for p in parts:
                to = place()
                if isinstance(p, str):
                    self.by_word[at][words[p]] = to
                elif isinstance(p, list):
                    self.free[at].append(to)
                    inner = place()
                    self.free[at].append(inner)
                    self.free[lay(p, inner)].append(to)
                else:
                    for k in range(p[1] + 1):
                        if k >= p[0]:
                            self.free[at].append(to)
                        if k < p[1]:
                            after = place()
                            self.by_any[at] = after
                            at = after
                at = to
            return at

        begin = place()
        for number, plan in enumerate(plans):
            own = place()
            self.free[begin].append(own)
            self.accepts[lay(plan, own)] = number
        self.begin = self._closed({begin})
        self.renew()

    def _closed(self, places: set[int]) -> frozenset[int]:
        todo, seen = list(places), set(places)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    def renew(self) -> None:
        """Forgets all states but the first."""
        self.states, self.number = [self.begin], {self.begin: 0}
        self.table = np.full((64, self.end + 1), -2, np.int32)  # -2: not known yet, -1: no way on
        self.table[:, self.end] = -1
        self.found: list[tuple[int, ...]] = [()]
        self.accepting = np.zeros(64, bool)
        self.first = np.array([self._step(0, s) >= 0 for s in range(self.end + 1)])

    def _step(self, state: int, symbol: int) -> int:
        if symbol == self.end:
            return -1
        reached = {to for p in self.states[state] if (to := self.by_word[p].get(symbol, -1)) >= 0} | {self.by_any[p] for p in self.states[state] if self.by_any[p] >= 0}
        if not reached:
            self.table[state, symbol] = -1
            return -1
        places = self._closed(reached)
        to = self.number.get(places)
        if to is None:
            to = self.number[places] = len(self.states)
            self.states.append(places)
            self.found.append(tuple(sorted(self.accepts[p] for p in places if p in self.accepts)))
            if to >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -2)])
                self.table[:, self.end] = -1
                self.accepting = np.concatenate([self.accepting, np.zeros_like(self.accepting)])
            self.accepting[to] = bool(self.found[to])
        self.table[state, symbol] = to
        return to

    def matches(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, template, words) of the longest match of each template at each place; symbols end with the end of a document."""
        if len(self.states) > STATES:
            self.renew()
        places = np.flatnonzero(self.first[symbols])
        events = []
        for k in range(0, len(places), STARTS):
            start = places[k : k + STARTS]
            state, length = np.zeros(len(start), np.int32), 0
            while len(start):
                symbol = symbols[start + length]
                to = self.table[state, symbol]
                if (unknown := np.flatnonzero(to == -2)).size:
                    for s, x in set(zip(state[unknown].tolist(), symbol[unknown].tolist())):
                        self._step(s, x)
                    to = self.table[state, symbol]
                length += 1
                on = to >= 0
                start, state = start[on], to[on]
                if (hit := self.accepting[state]).any():
                    events.append((start[hit], state[hit], length))
        out = [(np.repeat(start[at], len(self.found[s])), np.tile(np.array(self.found[s], np.int64), int(at.sum())), length) for start, state, length in events for s in np.unique(state) if (at := state == s).any()]
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        place, template, length = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.concatenate([np.full(len(x[0]), x[2]) for x in out])
        order = np.lexsort((length, template, place))
        place, template, length = place[order], template[order], length[order]
        last = np.append((place[1:] != place[:-1]) | (template[1:] != template[:-1]), True)
        return place[last], template[last], length[last]


_MATCH = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("template", pa.int32()), ("first_word", pa.int64()), ("words", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("matches", pa.list_(_MATCH))])


def matched(batch: pa.RecordBatch, automaton: Automaton, templates: tuple[Template, ...], limit: int = CHUNK_BYTES) -> pa.RecordBatch:
    """Word counts and matches of a batch (doc_id, text as bytes)."""
    label, base = np.array([t.label for t in templates], object), np.array([t.base for t in templates])
    n = np.zeros(batch.num_rows, np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    held: list = []  # a text that comes in pieces: its row and the symbols so far

    def close() -> None:
        if held:
            place, template, length = automaton.matches(np.concatenate([*held[1:], np.array([automaton.end], np.int32)]))
            found.append((np.full(len(place), held[0]), template, place, length))
            held.clear()

    for first, end, data, offsets in word_chunks(batch, "text", limit):
        start, stop, doc = word_ranges(data, offsets)
        number = automaton.vocabulary.numbers(data, start, stop)
        symbols = np.where(number >= 0, number, automaton.other).astype(np.int32)
        count = np.bincount(doc, minlength=end - first)
        n[first:end] += count
        if held and held[0] != first:
            close()
        if end - first == 1:
            held.extend([symbols] if held else [first, symbols])
            continue
        whole = np.full(len(symbols) + len(count), automaton.end, np.int32)
        whole[np.arange(len(symbols)) + doc] = symbols
        place, template, length = automaton.matches(whole)
        begins = np.cumsum(count) - count + np.arange(len(count))
        at = np.searchsorted(begins, place, side="right") - 1
        found.append((first + at, template, place - begins[at], length))
    close()
    row, template, place, length = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(4))
    order = np.lexsort((template, place, row))
    row, template, place, length = row[order], template[order], place[order], length[order]
    columns = [pa.array(label[template], pa.string()), pa.array(base[template], pa.bool_()), pa.array(template, pa.int32()), pa.array(place, pa.int64()), pa.array(length, pa.int64())]
    lists = pa.ListArray.from_arrays(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32), pa.StructArray.from_arrays(columns, fields=list(_MATCH)))
    return emit(_FOUND, [batch.column(0), n, lists])


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, matches: label, base, template, first_word, words) of every whole text: a map over the scan."""
    small_batches(docs.sparkSession)
    for t in templates:
        parsed(t.wording)  # refuses wrong markup before any work is done

    def run(batches: Batches) -> Batches:
        automaton = Automaton(templates)
        for batch in batches:
            yield matched(batch, automaton, templates)

    kind = "array<struct<label:string,base:boolean,template:int,first_word:bigint,words:bigint>>"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), as_bytes().alias("text")).mapInArrow(run, f"doc_id bigint, n_words bigint, matches {kind}")


def license_labels(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    base = F.filter("matches", lambda m: m["base"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    size = F.array(*(F.lit(float(mandatory(t))) for t in templates))
    longest = F.array_max(F.transform("matches", lambda m: F.get(size, m["template"])))
    return scan(docs, templates).select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(base["first_word"]).alias("first_word"),
        F.array_max(base["first_word"]).alias("last_word"),
        joined(base["label"]).alias("base_labels"),
        joined(F.col("matches.label")).alias("labels"),
        F.coalesce(1 - 1 / (1 + longest), F.lit(0.0)).alias("score"),
    )


def _pattern(parts: list) -> str:
    """A template as a regular expression over words that a blank follows."""
    one = lambda p: f"{p} " if isinstance(p, str) else f"(?:[^ ]+ ){{{p[0]},{p[1]}}}" if isinstance(p, tuple) else f"(?:{_pattern(p)})?"
    return "".join(map(one, parts))


def oracle_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    has = {t: f"regexp_matches(s, ' {_pattern(parsed(t.wording))}')" for t in templates}
    labels = lambda ts: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {has[t]} THEN '{t.label}' END" for t in ts) + "], lambda x: x IS NOT NULL))), ',')"
    places = " OR ".join("(" + " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(parsed(b.wording), 1)) + ")" for b in templates if b.base)
    scores = ", ".join(f"CASE WHEN {has[t]} THEN 1 - 1 / (1 + {mandatory(t)})::DOUBLE ELSE 0 END" for t in templates)
    return rf"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS t FROM documents),
b AS (SELECT doc_id, t, ' ' || array_to_string(t, ' ') || ' ' AS s, list_filter(range(len(t)), lambda i: {places}) AS p FROM w)
SELECT doc_id, len(t)::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, {labels([t for t in templates if t.base])} AS base_labels, {labels(templates)} AS labels, greatest({scores}) AS score FROM b"""
