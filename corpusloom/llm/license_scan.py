"""Licence scans: templates with optional and replaceable regions as token automata.

A template is text with <<opt>>...<</opt>> around wording that may be missing and
<<var min max>> for wording that may be replaced by min to max words. It compiles
into an automaton over words; a text holds the licence where the automaton
accepts, that is where all mandatory wording stands exactly. Only texts that
hold the template's rarest kind of word, its longest mandatory one, are run, and
only from places where a template can begin; a run ends with the template, so
work stays in proportion to the text.

Base phrases are found for every text besides.

Nulls and odd rows: a null text counts as empty, with no labels and score 0;
repeated rows get equal results; extra columns are untouched; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words are runs of a-z, 0-9 and bytes of non-ASCII characters, after lowering A-Z.
TO_WORDS = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20) for b in range(256))

#: Phrases and labels of the contract.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, what an acceptance is worth, template: notices, grants without their disclaimers, and whole licences.
# The wording of the licences.
TEMPLATES = (
    ("mit", 0.9, "<<opt>>released<</opt>> <<opt>>licensed<</opt>> under the <<opt>>terms of the<</opt>> mit license"),
    ("apache-2.0", 0.9, "licensed under the apache license version 2 0"),
    ("cc-by-nc", 0.9, "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>creative commons<</opt>> cc by nc <<opt>>4 0<</opt>> <<opt>>international<</opt>>"),
    ("cc-by", 0.9, "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> creative commons attribution <<opt>>4 0<</opt>> <<opt>>3 0<</opt>> <<opt>>international<</opt>> license"),
    ("gpl", 0.9, "licensed under the <<opt>>terms of the<</opt>> gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license <<opt>>version <<var 1 2>><</opt>>"),
    ("reserved", 0.8, "<<opt>>copyright <<var 1 12>><</opt>> all rights reserved"),
    ("mit", 0.95, """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to use
        copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software
        is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software"""),
    ("isc", 0.95, """permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies"""),
    ("bsd", 0.95, """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and
        the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of
        conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        <<opt>>neither the name of <<var 1 12>> nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission<</opt>>"""),
    ("apache-2.0", 1.0, """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
        license you may obtain a copy of the license at <<var 1 12>> unless required by applicable law or agreed to in writing software
        distributed under the license is distributed on an as is basis without warranties or conditions of any kind"""),
    ("gpl", 1.0, """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
        published by the free software foundation either version <<var 1 2>> of the license or at your option any later version"""),
    ("mit", 1.0, """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to use
        copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software
        is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
        merchantability fitness for a particular purpose and noninfringement in no event shall <<var 2 8>> be liable for any claim
        damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
        software or the use or other dealings in the software"""),
    ("isc", 1.0, """permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and <<var 2 8>> all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall <<var 2 8>> be liable for any special direct indirect or consequential damages or
        any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
        action arising out of or in connection with the use or performance of this software"""),
    ("bsd", 1.0, """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met <<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and
        the following disclaimer <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of
        conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        <<opt>><<opt>>3<</opt>> neither the name of <<var 1 12>> nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission<</opt>>
        this software is provided by <<var 3 10>> as is and any express or implied warranties including but not limited to the implied
        warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 3 10>> be liable for
        any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute
        goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in
        contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if
        advised of the possibility of such damage"""),
)


@dataclass
class Automaton:
    """States 0 to accept; a state has word edges, free edges, or an edge for any word."""

    label: str
    worth: float
    words: list[dict[bytes, int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    anything: list[int | None] = field(default_factory=list)
    accept: int = 0
    required: bytes = b""
    first: set[bytes] = field(default_factory=set)

    def state(self) -> int:
        self.words.append({})
        self.free.append([])
        self.anything.append(None)
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def longest(self, words: list[bytes], start: int) -> int | None:
        """The end of the longest acceptance from start, or None."""
        now, end = self.closure({0}), None
        for at in range(start, len(words) + 1):
            if self.accept in now:
                end = at
            if at == len(words):
                break
            moved = {self.words[s][words[at]] for s in now if words[at] in self.words[s]} | {self.anything[s] for s in now if self.anything[s] is not None}
            if not moved:
                break
            now = self.closure(moved)
        return end


MARK = re.compile(r"<<opt>>|<</opt>>|<<var \d+ \d+>>|[^<\s]+")


def compile_template(label: str, worth: float, template: str) -> Automaton:
    """The automaton of a template; it must begin with a word, optional or not."""
    out = Automaton(label, worth)
    at, opened, mandatory = out.state(), [], []
    for mark in MARK.findall(template):
        if mark == "<<opt>>":
            opened.append(at)
        elif mark == "<</opt>>":
            joined = out.state()
            out.free[at].append(joined)
            out.free[opened.pop()].append(joined)
            at = joined
        elif mark.startswith("<<var"):
            least, most = map(int, mark[6:-2].split())
            exits = []
            for n in range(most):
                if n >= least:
                    exits.append(at)
                out.anything[at] = nxt = out.state()
                at = nxt
            end = out.state()
            for s in [*exits, at]:
                out.free[s].append(end)
            at = end
        else:
            for word in mark.encode().translate(TO_WORDS).split():
                nxt = out.state()
                out.words[at][word] = nxt
                at = nxt
                if not opened:
                    mandatory.append(word)
    if opened or not mandatory:
        raise ValueError(f"template of {label} has an open region or no mandatory word")
    out.accept = at
    out.required = max(mandatory, key=len)
    begin = out.closure({0})
    if any(out.anything[s] is not None for s in begin):
        raise ValueError(f"template of {label} begins with a replaceable region")
    out.first = {w for s in begin for w in out.words[s]}
    return out


def scan(text: str | None, automata: list[Automaton], base: list[tuple[list[bytes], str]]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, matches of one text."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS)
    wanted = [(a, set()) for a in automata if a.required in data]
    phrases = [(p, label) for p, label in base if b" ".join(p[:1]) in data and p[-1] in data]
    if not wanted and not phrases:
        return len(data.split()), 0, None, None, "", "", 0.0, []
    words = data.split()
    places, base_labels = [], set()
    for phrase, label in phrases:
        at = -1
        with_label = False
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(phrase)] == phrase:
                places.append(at)
                with_label = True
        if with_label:
            base_labels.add(label)
    matches, score = [], 0.5 if places else 0.0
    for a, _ in wanted:
        for first in a.first:
            at = -1
            while True:
                try:
                    at = words.index(first, at + 1)
                except ValueError:
                    break
                end = a.longest(words, at)
                if end is not None:
                    matches.append((a.label, at, end))
                    score = max(score, a.worth)
    labels = base_labels | {m[0] for m in matches}
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, sorted(set(matches)),
    )


RESULT = (
    "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,"
    "matches:array<struct<label:string,start:long,stop:long>>>"
)
FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]


def scan_licenses(text: Column, templates=TEMPLATES, base=BASE) -> Column:
    """The scan of a text column as a struct; matches give the words that each template accepts."""
    automata = [compile_template(*t) for t in templates]
    phrases = [(p.encode().split(), label) for p, label in base]

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = pd.DataFrame([scan(t, automata, phrases) for t in texts], columns=FIELDS)
            out["matches"] = [[{"label": m[0], "start": m[1], "stop": m[2]} for m in ms] for ms in out["matches"]]
            yield out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})

    return run(text)
