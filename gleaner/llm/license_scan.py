"""License scans: notice phrases and identifier tags in whole texts.

An Aho-Corasick automaton over words finds all phrases in one pass, however
many there are.  Some phrases are notices and have a label; others are tags,
which a licence expression follows on the same line (``SPDX-License-Identifier:
MIT OR (GPL-2.0-only WITH Classpath-exception-2.0)``).  A shunting-yard parser
evaluates it: each identifier has a label and a strength (0: free, 1: binds
most), OR takes the weaker side, AND the stronger one, and WITH an exception
eases what it belongs to.  A text's score is the strength of the strongest of
its notices and expressions, all of which hold; 0 if there is none.

An expression is read as far as it makes sense, and prose after it is left: it
ends before a word that is no licence name, an operator without a right side
or a bracket that wasn't opened; brackets that stay open are closed.  Operators
are read in either case.

Each text is scanned on its own where it lies; nothing is shuffled.

Edge cases.  Null and empty texts have no words and no labels, and score 0.
Long texts are scanned whole, in one pass.  Overlapping places all count, at
equal starts the shorter phrase first.  Rows that repeat an id, or have none,
are scanned one by one.  Other columns are not read, so none can clash.  No
rows give no rows.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORD, input_columns, package_on_workers, released

#: Phrases of the contract, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notices.
ADDED = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
#: What a licence expression follows.
TAGS = ("spdx license identifier", "license expression")
#: How much each label binds; identifiers begin with a label (``gpl-2.0-only``).
STRENGTH = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "0bsd": 0.0,
    "mit": 0.1, "bsd": 0.1, "isc": 0.1, "zlib": 0.1, "bsl": 0.1,
    "apache": 0.2, "cc-by": 0.3,
    "mpl": 0.5, "epl": 0.5, "lgpl": 0.6, "cc-by-sa": 0.7,
    "gpl": 0.8, "agpl": 0.9, "cc-by-nd": 0.9, "cc-by-nc": 0.9,
    "licenseref": 0.9, "reserved": 1.0,
}
#: What an exception leaves of a licence's strength.
EASED = 0.75

_BINDS = {"OR": 1, "AND": 2, "WITH": 3}
_WORD = re.compile(WORD.encode())
_ANY_CASE = re.compile(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.:_+-]*)")
_LEAD = re.compile(r"[ \t:=\"']*")

Value = tuple[frozenset[str], float]  # labels and strength


def words_of(text: str | None) -> list[bytes]:
    """The words, in UTF-8; only A-Z are lower-cased."""
    return _WORD.findall((text or "").encode().lower())


class Automaton:
    """Aho-Corasick over words: all places of all phrases in one pass."""

    def __init__(self, phrases: Iterable[str]):
        self._next: list[dict[bytes, int]] = [{}]
        self._fail, self._ends = [0], [()]
        for number, phrase in enumerate(phrases):
            words = words_of(phrase)
            if not words:
                raise ValueError(f"a phrase without words: {phrase!r}")
            at = 0
            for w in words:
                if w not in self._next[at]:
                    self._next[at][w] = len(self._next)
                    self._next.append({})
                    self._fail.append(0)
                    self._ends.append(())
                at = self._next[at][w]
            self._ends[at] += ((len(words), number),)
        queue = deque(self._next[0].values())
        while queue:
            at = queue.popleft()
            for w, to in self._next[at].items():
                back = self._fail[at]
                while back and w not in self._next[back]:
                    back = self._fail[back]
                self._fail[to] = self._next[back].get(w, 0)
                self._ends[to] += self._ends[self._fail[to]]
                queue.append(to)

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(start, words, number of the phrase), by start and length."""
        out, at = [], 0
        for place, w in enumerate(words):
            while at and w not in self._next[at]:
                at = self._fail[at]
            at = self._next[at].get(w, 0)
            if self._ends[at]:
                out += [(place + 1 - n, n, number) for n, number in self._ends[at]]
        return sorted(out)


def label_of(identifier: str) -> str | None:
    """The longest label that an identifier is or begins with, up to a hyphen."""
    parts = identifier.lower().rstrip("+").split("-")
    names = ("-".join(parts[:n]) for n in range(len(parts), 0, -1))
    return next((x for x in names if x in STRENGTH), None)


def _apply(operator: str, values: list[Value]) -> None:
    b, a = values.pop(), values.pop()
    strength = {"OR": min(a[1], b[1]), "AND": max(a[1], b[1]), "WITH": a[1] * EASED}[operator]
    values.append((a[0] | b[0], strength))


def evaluate(text: str, at: int = 0) -> tuple[Value, int, int] | None:
    """Labels and strength of the licence expression at this place of a text,
    and where it begins and ends; None if there is none."""
    values: list[Value] = []
    waiting: list[str] = []
    begin = at = end = _LEAD.match(text, at).end()
    operand = True
    while m := _TOKEN.match(text, at):
        token = m[1]
        operator = token.upper() if token.upper() in _BINDS else None
        if operand and token == "(" and waiting[-1:] != ["WITH"]:
            waiting.append("(")
        elif operand and waiting[-1:] == ["WITH"] and token not in "()" and not operator:
            values.append((frozenset(), 0.0))
            operand = False
        elif operand and (label := label_of(token)):
            values.append((frozenset([label]), STRENGTH[label]))
            operand = False
        elif not operand and token == ")" and "(" in waiting:
            while (top := waiting.pop()) != "(":
                _apply(top, values)
        elif not operand and operator:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[operator]:
                _apply(waiting.pop(), values)
            waiting.append(operator)
            operand = True
        else:
            break
        at = m.end()
        end = at if not operand else end
    while operand and waiting and waiting.pop() == "(":
        pass  # what has no right side goes, the operator last
    while waiting:
        if (top := waiting.pop()) != "(":
            _apply(top, values)
    return (values[0], begin, end) if values else None


class Scanner:
    """What is found in one text."""

    def __init__(self, base: dict[str, str], added: dict[str, str], tags: Iterable[str]):
        unknown = {*base.values(), *added.values()} - STRENGTH.keys()
        if unknown:
            raise ValueError(f"labels without a strength: {sorted(unknown)}")
        self._phrases = [(p, x, True) for p, x in base.items()] + [(p, x, False) for p, x in added.items()] + [(p, None, False) for p in tags]
        self._automaton = Automaton(p for p, _, _ in self._phrases)

    def scan(self, text: str | None) -> tuple[int, list, list, list[str], float]:
        """Words, places (start, label, base), expressions (start, text, labels,
        strength), labels and score."""
        words = words_of(text)
        places, expressions, tags = [], [], []
        for start, n, number in self._automaton.find(words):
            _, label, base = self._phrases[number]
            if label is None:
                tags.append((start, start + n - 1))
            else:
                places.append((start, label, base))
        if tags:
            ends = {last: 0 for _, last in tags}
            for place, m in enumerate(_ANY_CASE.finditer(text)):
                if place in ends:
                    ends[place] = m.end()
            for start, last in tags:
                if found := evaluate(text, ends[last]):
                    (labels, strength), begin, end = found
                    expressions.append((start, text[begin:end], sorted(labels), strength))
        labels = {x for _, x, _ in places}.union(*(x for _, _, x, _ in expressions))
        score = max([STRENGTH[x] for _, x, _ in places] + [s for *_, s in expressions], default=0.0)
        return len(words), places, expressions, sorted(labels), score


_KINDS = {
    "n_words": ("long", pa.int64()),
    "places": ("array<struct<start: long, label: string, base: boolean>>", pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))),
    "expressions": (
        "array<struct<start: long, text: string, labels: array<string>, strength: double>>",
        pa.list_(pa.struct([("start", pa.int64()), ("text", pa.string()), ("labels", pa.list_(pa.string())), ("strength", pa.float64())])),
    ),
    "labels": ("array<string>", pa.list_(pa.string())),
    "score": ("double", pa.float64()),
}


def scan(
    docs: DataFrame,
    *,
    base: dict[str, str] = BASE,
    added: dict[str, str] = ADDED,
    tags: tuple[str, ...] = TAGS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, n_words, places, expressions, labels (sorted) and score of every row."""
    package_on_workers(docs.sparkSession)
    rows = docs.select(*input_columns(docs, id=id_col, text=text_col))
    # Checked here, so that a bad phrase fails before the job; built again by workers.
    Scanner(base, added, tags)
    named = lambda keys, row: dict(zip(keys, row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, added, tags)
        for batch in batches:
            found = [scanner.scan(x.as_py()) for x in batch.column("text")]
            columns = list(zip(*found)) or [()] * len(_KINDS)
            columns[1] = [[named(("start", "label", "base"), p) for p in x] for x in columns[1]]
            columns[2] = [[named(("start", "text", "labels", "strength"), e) for e in x] for x in columns[2]]
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, _KINDS.values())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", *_KINDS])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(released(run), ", ".join([f"id {kind}", *(f"{n} {k}" for n, (k, _) in _KINDS.items())]))
    return out.select(F.col("id").alias(id_col), *_KINDS)
