"""Licence notices, matched by templates with optional and replaceable regions.

A template is wording in which ``[[...]]`` may be left out and ``{{name:a-b}}``
stands for any a to b words.  It is compiled into an automaton over tokens that
accepts exactly the wordings it allows.  A text is tried only where it has the
template's longest mandatory run of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes

# The phrases that count as base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: label -> template; words are compared after lower-casing and without punctuation.
TEMPLATES = {
    "gpl-notice": (
        "[[this {{work:1-2}} is]] licensed under [[the terms of]] the gnu general public license "
        "[[version {{version:1-2}} [[or [[at your option]] any later version]]]]"
    ),
    "gpl-header": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version {{version:1-2}} of the license "
        "or [[at your option]] any later version"
    ),
    "apache-notice": "licensed under the apache license [[version {{version:1-2}}]]",
    "cc-by-notice": "licensed under [[a]] [[the]] [[creative commons attribution]] cc by [[{{terms:1-2}}]] {{version:2-2}}",
    "mit-notice": "[[this {{work:1-2}} is]] released under [[the terms of]] the mit license",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this {{thing:1-6}} to deal in the "
        "{{thing:1-3}} without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the {{thing:1-3}}"
    ),
    "isc-text": (
        "permission to use copy modify and or distribute this {{thing:1-4}} for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met [[1]] redistributions of source code must retain the above copyright notice"
    ),
}

#: ASCII letters lowered, other ASCII but digits to a blank; all other bytes belong to words.
WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256)
)


class Automaton:
    """A nondeterministic automaton over tokens; state 0 starts, the last state accepts."""

    def __init__(self, template: str) -> None:
        self.words: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.skip: list[list[int]] = [[]]
        tokens = re.findall(r"\[\[|\]\]|\{\{[^{}]*\}\}|[^\s\[\]{}]+", template)
        self.accept, rest = self._sequence(tokens, 0, 0)
        if rest != len(tokens):
            raise ValueError(f"unbalanced brackets in {template!r}")
        self.anchor, self.before = self._anchor(tokens)

    def _state(self) -> int:
        self.words.append({})
        self.any.append(None)
        self.skip.append([])
        return len(self.words) - 1

    def _sequence(self, tokens: list[str], at: int, state: int) -> tuple[int, int]:
        while at < len(tokens) and tokens[at] != "]]":
            token = tokens[at]
            if token == "[[":
                entry = state
                state, at = self._sequence(tokens, at + 1, state)
                if at == len(tokens):
                    raise ValueError("an optional region does not end")
                end = self._state()
                self.skip[state].append(end)
                self.skip[entry].append(end)
                state = end
            elif token.startswith("{{"):
                least, most = map(int, token[2:-2].rpartition(":")[2].split("-"))
                end = self._state() if most > least else None
                for k in range(most):
                    if k >= least:
                        self.skip[state].append(end)
                    # a state of its own, so that skipping does not add words elsewhere
                    following = self._state()
                    self.any[state] = following
                    state = following
                if end is not None:
                    self.skip[state].append(end)
                    state = end
            else:
                following = self._state()
                self.words[state][token.encode()] = following
                state = following
            at += 1
        return state, at

    @staticmethod
    def _anchor(tokens: list[str]) -> tuple[list[bytes], tuple[int, int]]:
        """The longest mandatory run of words, and the fewest and most words that can stand before it."""
        best: tuple[list[bytes], tuple[int, int]] = ([], (0, 0))
        run: list[bytes] = []
        depth, least, most, at_run = 0, 0, 0, (0, 0)
        for token in [*tokens, "[["]:
            if depth == 0 and token not in ("[[", "]]") and not token.startswith("{{"):
                if not run:
                    at_run = (least, most)
                run.append(token.encode())
                least, most = least + 1, most + 1
                continue
            if len(run) > len(best[0]):
                best = (run, at_run)
            run = []
            if token == "[[":
                depth += 1
            elif token == "]]":
                depth -= 1
            else:
                a, b = (1, 1) if not token.startswith("{{") else map(int, token[2:-2].rpartition(":")[2].split("-"))
                least, most = least + (a if depth == 0 else 0), most + b
        if not best[0]:
            raise ValueError("a template needs a mandatory word")
        return best

    def _closed(self, states: Iterable[int]) -> set[int]:
        seen: set[int] = set()
        todo = list(states)
        while todo:
            s = todo.pop()
            if s not in seen:
                seen.add(s)
                todo.extend(self.skip[s])
        return seen

    def longest(self, words: list[bytes], start: int) -> int | None:
        """End of the longest accepted wording from ``start``, if any."""
        states, end = self._closed([0]), None
        for at in range(start, len(words) + 1):
            if self.accept in states:
                end = at
            if at == len(words) or not states:
                break
            word = words[at]
            states = self._closed(
                [t for s in states for t in (self.words[s].get(word), self.any[s]) if t is not None]
            )
        return end


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word indexes at which the phrase stands in a line whose words are set off by one blank."""
    found, word, last = [], 0, 0
    at = line.find(phrase)
    while at >= 0:
        word += line.count(b" ", last, at)
        last = at
        found.append(word)
        at = line.find(phrase, at + 1)
    return found


def scan(text: bytes, phrases: Mapping[bytes, str], automata: Mapping[str, Automaton]) -> tuple:
    words = text.translate(WORDS).split()
    line = b" " + b" ".join(words) + b" "
    starts: list[int] = []
    base: set[str] = set()
    covered: list[tuple[int, int]] = []
    for phrase, label in phrases.items():
        found = places(line, phrase)
        if found:
            base.add(label)
            starts += found
            length = phrase.count(b" ") - 1
            covered += [(s, s + length) for s in found]
    labels = set(base)
    for label, automaton in automata.items():
        least, most = automaton.before
        tried = -1
        for place in places(line, b" " + b" ".join(automaton.anchor) + b" "):
            # the earliest start takes in the optional words before
            for start in range(max(place - most, tried + 1, 0), place - least + 1):
                tried = start
                end = automaton.longest(words, start)
                if end is not None and end > place:
                    labels.add(label)
                    covered.append((start, end))
                    tried = max(tried, place - least)
                    break
    inside, last = 0, 0
    for a, b in sorted(covered):
        inside += max(b - max(a, last), 0)
        last = max(last, b)
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(labels)),
        inside / len(words) if words else 0.0,
    )


NAMES = "n_words n_base first_word last_word base_labels labels score".split()
KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
DDL = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double>"


def license_scan(text: Column, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> Column:
    """A struct of what is found in the text (a string column).

    n_words; n_base places of the phrases with their first_word and last_word
    (null if none); base_labels and labels, sorted and comma-joined, empty if
    none; score, the share of words that belong to a phrase or an accepted
    template (0 without words).
    """
    automata = {label: Automaton(t) for label, t in templates.items()}
    lines = {f" {p} ".encode(): label for p, label in phrases.items()}

    @F.arrow_udf(DDL)
    def run(texts: pa.Array) -> pa.Array:
        rows = [scan(t.as_py(), lines, automata) for t in texts]
        columns = zip(*rows) if rows else [[] for _ in NAMES]
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, KINDS)], names=NAMES)

    return run(as_bytes(text))


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id and the fields of :func:`license_scan` per row of ``docs``.

    Null texts count as empty; null ids and repeated rows are rows like others; an
    empty table gives no rows.  Other columns are not read.
    """
    found = license_scan(F.col(text), **options)
    return docs.select(F.col(doc_id).alias("doc_id"), found.alias("found_")).select("doc_id", "found_.*")
