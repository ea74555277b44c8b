"""License scans by template-markup matching.

A template is wording with markup: ``<<optional>> … <<end>>`` is a region that
may be missing, ``<<any 1-8>>`` stands for one to eight arbitrary words. It is
compiled into an automaton over tokens; a place is accepted only if all
mandatory wording follows exactly, in order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from coppice.llm.textwork import map_batches, pick, texts

# Phrases and labels of the base scan.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License wordings, public texts.
TEMPLATES = (
    ("apache-2.0", "licensed under the Apache License <<optional>>version<<end>> 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"
            " <<optional>>provided that the following conditions are met<<end>>"),
    ("cc-by-4.0", "CC BY 4 0"),
    ("cc-by-nc-4.0", "CC BY NC 4 0"),
    ("cc-by-sa-4.0", "CC BY SA 4 0"),
    ("copyright", "copyright <<optional>>c<<end>> <<any 1-8>> all rights reserved"),
    ("gpl-3.0", "GNU General Public License <<optional>>as published by the Free Software Foundation<<end>>"
                " <<optional>>either<<end>> version 3 <<optional>>or <<optional>>at your option<<end>> any later version<<end>>"),
    ("mit", "under the <<optional>>terms of the<<end>> MIT License"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of <<any 1-8>>"
            " associated documentation files"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License v 2 0"),
)

#: Everything that is no letter, digit or byte above 127 separates words.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def license_words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


@dataclass(frozen=True)
class Automaton:
    """States are numbers; ``steps[s]`` are (word or None for any, next), ``free[s]`` are moves without a word."""

    label: str
    anchor: bytes
    steps: tuple
    free: tuple
    last: int

    def _spread(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes], start: int) -> bool:
        """Whether the template's wording stands at word ``start``."""
        states = self._spread({0})
        for i in range(start, len(words)):
            if self.last in states:
                return True
            states = self._spread({n for s in states for word, n in self.steps[s] if word is None or word == words[i]})
            if not states:
                return False
        return self.last in states


def compile_template(label: str, markup: str) -> Automaton:
    """Compile a template; it must begin with mandatory wording and its regions must be closed."""
    steps: list[list] = [[]]
    free: list[list[int]] = [[]]
    opened: list[int] = []
    leading: list[bytes] = []
    plain = True

    def state() -> int:
        steps.append([])
        free.append([])
        return len(steps) - 1

    at = 0
    for piece in re.findall(r"<<[^>]*>>|[^<]+", markup):
        if piece == "<<optional>>":
            opened.append(at)
            plain = False
        elif piece == "<<end>>":
            if not opened:
                raise ValueError(f"template {label} closes a region that it has not opened")
            after = state()
            free[at].append(after)
            free[opened.pop()].append(after)
            at = after
        elif m := re.fullmatch(r"<<any (\d+)-(\d+)>>", piece):
            plain = False
            low, high = int(m[1]), int(m[2])
            skips = []
            for n in range(high):
                if n >= low:
                    skips.append(at)
                after = state()
                steps[at].append((None, after))
                at = after
            for s in skips:
                free[s].append(at)
        elif piece.startswith("<<"):
            raise ValueError(f"template {label} has unknown markup {piece}")
        else:
            for word in license_words(piece.encode()):
                after = state()
                steps[at].append((word, after))
                at = after
                if plain:
                    leading.append(word)
    if opened or not leading:
        raise ValueError(f"template {label} must begin with mandatory wording and close its regions")
    return Automaton(label, b" " + b" ".join(leading) + b" ", tuple(map(tuple, steps)), tuple(map(tuple, free)), at)


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which ``phrase`` stands; both are words with single spaces around each."""
    found, p = [], line.find(phrase)
    while p >= 0:
        found.append(line.count(b" ", 0, p))
        p = line.find(phrase, p + 1)
    return found


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  templates=TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """Scan every whole text for license phrases and templates.

    Returns one row per input row: ``doc_id``, ``n_words``, ``n_base`` (places
    of base phrases), ``first_word`` and ``last_word`` (smallest and largest
    start of such places, null without any), ``base_labels``, ``labels`` (base
    and templates; distinct, sorted, joined by commas) and ``score``: 1 if a
    template is accepted, 0.5 if only base phrases stand there, else 0.

    A null or empty text has no words and no labels. Repeated rows and null
    ids give a row each; other columns are not read. No rows give no rows.
    """
    automata = [compile_template(*t) for t in templates]
    phrases = [(b" " + b" ".join(license_words(p.encode())) + b" ", label) for p, label in base.items()]

    def work(batch):
        out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for text in texts(batch.column(1)):
            words = license_words(text)
            line = b" " + b" ".join(words) + b" "
            starts, plain = [], set()
            for phrase, label in phrases:
                if found := places(line, phrase):
                    starts += found
                    plain.add(label)
            own = {a.label for a in automata if a.anchor in line
                   and any(a.accepts(words, i) for i in places(line, a.anchor))}
            out["n_words"].append(len(words))
            out["n_base"].append(len(starts))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(",".join(sorted(plain)))
            out["labels"].append(",".join(sorted(plain | own)))
            out["score"].append(1.0 if own else 0.5 if plain else 0.0)
        kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
        yield {"doc_id": batch.column(0)} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()}

    schema = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
              "score double")
    picked = pick(docs, doc_id=id_column, text=text_column)
    kind = picked.schema["doc_id"].dataType.simpleString()
    return map_batches(picked, work, f"doc_id {kind}, {schema}")
