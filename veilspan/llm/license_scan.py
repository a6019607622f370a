"""License scan by template-markup matching.

A template is the wording of a notice with marked regions:

    <<beginOptional>> words that may be left out <<endOptional>>
    <<var;name="holder";words="0-6">>               that many words of any kind
    <<var;name="version";match="[0-9]+";words="1">> words that each match the pattern

Regions may nest. All templates are compiled into one automaton over words; it is made deterministic lazily, as
texts are read. A template is accepted where its mandatory wording stands exactly, word for word. Words are the
maximal runs of ASCII letters, digits and characters outside ASCII, ASCII letters in lower case, so punctuation, case
and layout never matter. Matching starts only at words that can start a template, and each start reads no more words
than the longest template has: the work is linear in the text and needs no shuffle.

Null and empty texts have no words and no spans. Repeated rows each get their own result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm import _text

_MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:;[^<>]*)?)>>")
_ATTRIBUTE = re.compile(r';(\w+)="([^"]*)"')
_WORD = re.compile(r"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Template:
    """name: unique; label: what a match says; base: a plain phrase, counted at all its places."""

    name: str
    label: str
    markup: str
    base: bool = False


#: Phrases whose places are counted, with their labels.
BASE = (
    Template("phrase-gpl", "gpl", "gnu general public license", True),
    Template("phrase-apache", "apache", "apache license", True),
    Template("phrase-cc-by", "cc-by", "cc by", True),
    Template("phrase-mit", "mit", "mit license", True),
)

_OPT, _END = "<<beginOptional>>", "<<endOptional>>"
_VERSION = '<<var;name="version";match="[0-9]+";words="1-2">>'
_OWNER = '<<var;name="owner";words="0-8">>'

#: Notices and license openings.
NOTICES = (
    Template("apache-2.0-notice", "apache-2.0", f"licensed under the apache license {_OPT} version {_END} 2.0"),
    Template("gpl-2.0-notice", "gpl-2.0", f"licensed under {_OPT} the terms of {_END} the gnu general public license version 2"),
    Template("gpl-3.0-notice", "gpl-3.0", f"licensed under {_OPT} the terms of {_END} the gnu general public license version 3"),
    Template("gpl-program", "gpl-notice", f"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation {_OPT} either {_END} version {_VERSION} of the license"),
    Template("lgpl-notice", "lgpl", f"gnu {_OPT} lesser {_END} {_OPT} library {_END} general public license {_OPT} version {_VERSION} {_END} lesser"),
    Template("lgpl-name", "lgpl", "gnu lesser general public license"),
    Template("mit-notice", "mit-notice", f"{_OPT} released {_END} under the {_OPT} terms of the {_END} mit license"),
    Template("mit-grant", "mit-grant", f"permission is hereby granted free of charge to any person obtaining a copy of {_OWNER} to deal in the software without restriction"),
    Template("cc-by-nc-notice", "cc-by-nc", f"licensed under {_OPT} a {_END} {_OPT} creative commons {_END} cc by nc {_VERSION}"),
    Template("cc-by-sa-notice", "cc-by-sa", f"licensed under {_OPT} a {_END} {_OPT} creative commons {_END} cc by sa {_VERSION}"),
    Template("cc-by-nd-notice", "cc-by-nd", f"licensed under {_OPT} a {_END} {_OPT} creative commons {_END} cc by nd {_VERSION}"),
    Template("cc-by-notice", "cc-by-notice", f"licensed under {_OPT} a {_END} {_OPT} creative commons {_END} cc by {_VERSION}"),
    Template("bsd-grant", "bsd", f"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("mpl-notice", "mpl", f"subject to the terms of the mozilla public license {_OPT} v {_END} {_VERSION}"),
)

TEMPLATES = BASE + NOTICES


@dataclass
class _Node:
    """A place in a template's wording. free: places reached without a word; steps: (word or pattern, place)."""

    free: list[int] = field(default_factory=list)
    words: dict[str, list[int]] = field(default_factory=dict)
    patterns: list[tuple[str, int]] = field(default_factory=list)
    accepts: str | None = None


def parse(markup: str) -> list:
    """The parts of a template: words, ("var", pattern, least, most) and ("optional", parts)."""
    stack: list[list] = [[]]
    at = 0
    for mark in [*_MARK.finditer(markup), None]:
        plain = markup[at : mark.start() if mark else len(markup)]
        stack[-1] += _WORD.findall(plain.lower())
        if mark is None:
            break
        at = mark.end()
        if mark[1] == "beginOptional":
            stack.append([])
        elif mark[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            part = stack.pop()
            stack[-1].append(("optional", part))
        else:
            has = dict(_ATTRIBUTE.findall(mark[2]))
            least, _, most = has.get("words", "1").partition("-")
            stack[-1].append(("var", has.get("match", ""), int(least), int(most or least)))
    if len(stack) != 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


def pattern_sql(parts: Sequence) -> str:
    """The parts as a pattern over words that are each followed by a blank."""
    out = ""
    for part in parts:
        if isinstance(part, str):
            out += f"{part} "
        elif part[0] == "optional":
            out += f"(?:{pattern_sql(part[1])})?"
        else:
            out += f"(?:{part[1] or '[^ ]+'} ){{{part[2]},{part[3]}}}"
    return out


class Automaton:
    """All templates as one automaton over words. run() gives the longest match of each template that starts at a word."""

    def __init__(self, templates: Sequence[Template]):
        self.nodes: list[_Node] = []
        roots = []
        for t in templates:
            root, last = self._node(), None
            last = self._add(root, parse(t.markup))
            self.nodes[last].accepts = t.name
            if root in self._closure({last}) or last in self._closure({root}):
                raise ValueError(f"template {t.name} has no mandatory word")
            roots.append(root)
        self.start = self._closure(set(roots))
        self.alphabet = {w for n in self.nodes for w in n.words}
        self.patterns = sorted({p for n in self.nodes for p, _ in n.patterns})
        self._compiled = [re.compile(p or ".+", re.S) for p in self.patterns]
        self._steps: dict[tuple, frozenset] = {}
        self._accepts: dict[frozenset, tuple[str, ...]] = {}
        if any(self.nodes[i].patterns for i in self.start):
            raise ValueError("a template must start with a word")

    def _node(self) -> int:
        self.nodes.append(_Node())
        return len(self.nodes) - 1

    def _add(self, at: int, parts: Sequence) -> int:
        for part in parts:
            nxt = self._node()
            if isinstance(part, str):
                self.nodes[at].words.setdefault(part, []).append(nxt)
            elif part[0] == "optional":
                self.nodes[self._add(at, part[1])].free.append(nxt)
                self.nodes[at].free.append(nxt)
            else:
                _, pattern, least, most = part
                for k in range(most):
                    if k >= least:
                        self.nodes[at].free.append(nxt)
                    step = self._node()
                    self.nodes[at].patterns.append((pattern, step))
                    at = step
                self.nodes[at].free.append(nxt)
            at = nxt
        return at

    def _closure(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for k in self.nodes[todo.pop()].free:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        return frozenset(seen)

    def first_words(self) -> set[str]:
        return {w for i in self.start for w in self.nodes[i].words}

    def step(self, states: frozenset, word: str) -> frozenset:
        kind = word if word in self.alphabet else ""
        fits = tuple(bool(c.fullmatch(word)) for c in self._compiled)
        key = (states, kind, fits)
        if (found := self._steps.get(key)) is None:
            hit = dict(zip(self.patterns, fits, strict=True))
            to = {k for i in states for k in self.nodes[i].words.get(word, ())}
            to |= {k for i in states for p, k in self.nodes[i].patterns if hit[p]}
            found = self._steps[key] = self._closure(to)
        return found

    def accepted(self, states: frozenset) -> tuple[str, ...]:
        if (found := self._accepts.get(states)) is None:
            found = self._accepts[states] = tuple(sorted({a for i in states if (a := self.nodes[i].accepts)}))
        return found

    def run(self, word, at: int, end: int) -> dict[str, int]:
        """The end of each template's longest match that starts at word at. word: gives the word at an index."""
        states, found = self.start, {}
        while states and at < end:
            states = self.step(states, word(at))
            at += 1
            for name in self.accepted(states):
                found[name] = at
        return found


def _hash_of(words: Sequence[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    return np.concatenate([b.words().hashes() for _, _, b in _text.blocks(pa.array(list(words)))])


def _scanner(templates: Sequence[Template]):
    auto = Automaton(templates)
    order = {t.name: k for k, t in enumerate(templates)}
    first = np.sort(_hash_of(sorted(auto.first_words())))

    def scan(block: _text.Block) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
        words = block.words()
        spans: list[list] = [[] for _ in range(block.n)]
        starts = np.flatnonzero(np.isin(words.hashes(), first))
        owner = np.searchsorted(words.at, starts, "right") - 1

        def word(i: int) -> str:
            return words.bytes_of(i).decode("latin-1")

        for i, text in zip(starts.tolist(), owner.tolist(), strict=True):
            base = int(words.at[text])
            for name, end in auto.run(word, i, int(words.at[text + 1])).items():
                spans[text].append((order[name], i - base, end - base))
        return words.per_text, spans

    return scan


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(id, n_words, spans): spans holds (template, label, base, start, end) in word positions, ordered by start,
    then by the order of templates; end is exclusive."""
    templates = tuple(templates)
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.struct([("template", pa.string()), ("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scanner(templates)
        for batch in batches:
            for low, high, block in _text.blocks(batch.column(1)):
                counts, spans = scan(block)
                rows = [[{"template": templates[k].name, "label": templates[k].label, "base": templates[k].base, "start": s, "end": e} for k, s, e in sorted(own, key=lambda x: (x[1], x[0]))] for own in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(counts, pa.int64()), pa.array(rows, pa.list_(span))], names=["id", "n_words", "spans"])

    schema = f"id {kind}, n_words long, spans array<struct<template:string,label:string,base:boolean,start:long,end:long>>"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scanned, schema)


def license_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per text: its words, the places of base phrases, the labels, and a score: 1 where the mandatory wording
    of a notice is accepted, 0.5 where only a base phrase stands, else 0."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scan_licenses(df, id_col, text_col, templates).select(
        F.col("id").alias(id_col),
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.when(F.exists("spans", lambda s: ~s["base"]), 1.0).when(F.size("spans") > 0, 0.5).otherwise(0.0).alias("score"),
    )
