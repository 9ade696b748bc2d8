"""License scans: one Aho-Corasick pass for notices and tags, and evaluation of expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: phrases (in words) and their labels
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
NOTICES = {
    "permission is hereby granted free of charge to any person": "mit-text",
    "redistribution and use in source and binary forms": "bsd-text",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "creative commons": "cc",
    "all rights reserved": "reserved",
    "released into the public domain": "public-domain",
}
TAG = "spdx license identifier"
# identifiers begin with these (longest first); strength: what they ask of a user
FAMILIES = (
    ("AGPL", "agpl", 3), ("Apache", "apache", 1), ("BSD", "bsd", 1), ("CC0", "cc", 0),
    ("CC", "cc", 2), ("EPL", "epl", 2), ("GPL", "gpl", 3), ("ISC", "isc", 1), ("LGPL", "lgpl", 2),
    ("MIT", "mit", 1), ("MPL", "mpl", 2), ("Unlicense", "public-domain", 0), ("Zlib", "zlib", 1),
)
CLASSES = ("public", "permissive", "weak-copyleft", "copyleft", "unknown")
UNKNOWN = 4
WORD_BYTES = bytes(
    b if b >= 0x80 or chr(b).isalnum() and b < 0x80 else 0x20 for b in range(256)
)
TAG_LINE = re.compile(r"SPDX-License-Identifier[^\S\r\n]*:[^\S\r\n]*([^\r\n]*)", re.I | re.A)
TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")


class BadExpression(ValueError):
    pass


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: WITH binds closest, then AND, then OR; all from the left."""
    binding = {"OR": 1, "AND": 2, "WITH": 3}
    out: list[str] = []
    stack: list[str] = []
    at, operand = 0, True  # whether an operand comes next
    expression = expression.rstrip()
    while at < len(expression):
        m = TOKEN.match(expression, at)
        if m is None:
            break  # what follows, such as a comment's end, is no part of it
        at, token = m.end(), m[1]
        operator = token.upper()
        if operator in binding:
            if operand:
                raise BadExpression(expression)
            while stack and stack[-1] != "(" and binding[stack[-1]] >= binding[operator]:
                out.append(stack.pop())
            stack.append(operator)
            operand = True
        elif token == "(":
            if not operand:
                raise BadExpression(expression)
            stack.append(token)
        elif token == ")":
            if operand:
                raise BadExpression(expression)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise BadExpression(expression)
            stack.pop()
        elif operand:
            out.append(token)
            operand = False
        else:
            break
    if operand or "(" in stack:
        raise BadExpression(expression)
    return out + stack[::-1]


def _family(identifier: str) -> tuple[str, int]:
    for prefix, label, strength in FAMILIES:
        if identifier.upper().startswith(prefix.upper()):
            return label, strength
    return "other", UNKNOWN


def evaluate(expression: str) -> tuple[set[str], str]:
    """The labels an expression names, and the class a user is bound to: the stricter side of AND,
    the freer side of OR; an exception (WITH) loosens a copyleft by one step."""
    labels: set[str] = set()
    stack: list[int | str] = []
    postfix = to_postfix(expression)
    for i, token in enumerate(postfix):
        if token in ("AND", "OR"):
            b, a = stack.pop(), stack.pop()
            stack.append(max(a, b) if token == "AND" else min(a, b))
        elif token == "WITH":
            stack.pop()
            strength = stack.pop()
            stack.append(strength - 1 if strength in (2, 3) else strength)
        else:
            label, strength = _family(token)
            if not (i + 1 < len(postfix) and postfix[i + 1] == "WITH"):
                labels.add(label)
            stack.append(strength)
    return labels, CLASSES[stack[0]]


class Scanner:
    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for phrase, label in {**NOTICES, **BASE_PHRASES}.items():
            self.automaton.add_word(f" {phrase} ", (phrase, label))
        self.automaton.add_word(f" {TAG} ", (TAG, None))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple:
        words = (text or "").encode().lower().translate(WORD_BYTES).split()
        # one character per byte, so that places are byte offsets
        line = f" {b' '.join(words).decode('latin-1')} "
        places, labels, base, notices, tags = [], set(), set(), 0, 0
        classes: list[str] = []
        for end, (phrase, label) in self.automaton.iter(line):
            if phrase in BASE_PHRASES:
                places.append(end - len(phrase) - 1)
                base.add(label)
            elif phrase == TAG:
                tags += 1
            else:
                notices += 1
                labels.add(label)
        if tags:
            for m in TAG_LINE.finditer(text):
                try:
                    named, kind = evaluate(m[1])
                    labels |= named
                    classes.append(kind)
                except BadExpression:
                    labels.add("bad-expression")
        first = last = None
        if places:
            first, last = (line.count(" ", 0, p + 1) - 1 for p in (min(places), max(places)))
        score = 1.0 if classes else 1 - 0.5 ** (len(places) + notices)
        labels |= base
        return (
            len(words), len(places), first, last, ",".join(sorted(base)),
            ",".join(sorted(labels)), score, ",".join(sorted(set(classes))),
        )


FIELDS = (
    ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"),
    ("base_labels", "string"), ("labels", "string"), ("score", "double"),
    ("expression_classes", "string"),
)
ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, words, base phrases with their first and last place (in
    words), labels, score (1 with a valid tag, else by the number of phrases), and the classes of
    the tags' expressions. Null text: no words. Null and repeated ids pass through; empty table: no
    rows. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            columns = zip(*rows) if rows else [()] * len(FIELDS)
            arrays = [pa.array(c, ARROW[kind]) for c, (_, kind) in zip(columns, FIELDS)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays], names=[id_col, *[n for n, _ in FIELDS]]
            )

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = ", ".join(f"{n} {kind}" for n, kind in FIELDS)
    return picked.mapInArrow(run, f"`{id_col}` long, {schema}")
