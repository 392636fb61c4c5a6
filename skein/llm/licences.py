"""Licence scan: one Aho-Corasick pass over a text's words finds notice phrases and identifier
tags; the expression after a tag goes through a shunting-yard parser and is evaluated.

Words are runs of digits, letters a-z and non-ASCII bytes after lower-casing A-Z; a phrase matches
where its words stand consecutively. An expression knows ``and``, ``or``, ``with`` (which binds
tightest), brackets and a ``+`` after an identifier. Its worth is taken from a policy: ``and``
is the least of its sides, ``or`` the greatest, ``with`` moves its licence half way to 1.
A document's score is the least worth of all its statements, 0 if it has none.

Prose that follows an expression on its line is not part of it: the longest start that parses counts.

Nulls and empty texts: no words, no labels, score 0. An expression that doesn't parse adds the
label ``malformed`` and the worth 0. Repeated rows are scanned each. Empty tables give empty results.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.text import blocks

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Phrases of notices beside the base ones.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "permission is hereby granted free of charge": "mit",
    "dedicated to the public domain": "public-domain",
    "cc0": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Worth of a label by its first parts, longest first; another identifier is worth UNKNOWN.
POLICY = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "bsl": 1.0, "zlib": 1.0, "cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0, "cc-by": 0.9,
    "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "all-rights-reserved": 0.1,
}
UNKNOWN = 0.3
MALFORMED = "malformed"

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_RANK = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")
_STEP = re.compile(rf"\s*({_TOKEN.pattern})")


def worth(label: str) -> float:
    parts = label.split("-")
    for n in range(len(parts), 0, -1):
        if (found := POLICY.get("-".join(parts[:n]))) is not None:
            return found
    return UNKNOWN


def to_postfix(expression: str) -> list[str] | None:
    """Shunting yard; None if brackets or operands don't fit."""
    out, stack, operand = [], [], False
    rest = _TOKEN.sub("", expression)
    if rest.strip():
        return None
    for token in _TOKEN.findall(expression):
        if token in _RANK:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if operand:
                return None
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def leading(said: str) -> str:
    """The longest start of a line that parses, if prose follows it; the whole line if it isn't an expression."""
    end, operand, depth, at = 0, False, 0, 0
    while m := _STEP.match(said, at):
        token = m[1]
        if token in _RANK or token == ")":
            if not operand or token == ")" and not depth:
                break
            depth -= token == ")"
            operand = token == ")"
        elif operand:
            return said[:end] if end else said
        else:
            depth += token == "("
            operand = token != "("
        at = m.end()
        if operand and not depth:
            end = at
    return said[:end] if end and end == at and operand else said


def evaluate(expression: str) -> tuple[float, set[str]]:
    """Worth and identifiers of an expression in lower case."""
    postfix = to_postfix(expression)
    if postfix is None:
        return 0.0, {MALFORMED}
    stack: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append((worth(token.rstrip("+")), {token.rstrip("+")}))
            continue
        (y, right), (x, left) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(((1 + x) / 2, left))
        else:
            stack.append((min(x, y) if token == "and" else max(x, y), left | right))
    return stack[0]


@lru_cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE, TAG: ""}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


_EXPRESSION = re.compile(rb"[^\S\n]*:?[^\S\n]*([^\n]*)")
_TAGGED = re.compile(rb"spdx[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+license[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+identifier(?![0-9a-z\x80-\xff])", re.I)


def expressions(raw: bytes) -> list[str]:
    """What follows each tag on its line, without the end of a comment."""
    out = []
    for m in _TAGGED.finditer(raw):
        said = _EXPRESSION.match(raw, m.end())[1].decode("utf-8", "replace").strip().lower()
        out.append(re.sub(r"\s*(\*/|-->|#}|\.)\s*$", "", said))
    return out


def scan(raw: bytes) -> dict:
    words = raw.translate(_WORDS).split()
    flat = f" {b' '.join(words).decode('latin-1')} "
    base, starts, labels, values, tagged = set(), [], set(), [], False
    n_base = 0
    for end, phrase in _automaton().iter(flat):
        if phrase in BASE:
            n_base += 1
            starts.append(end - len(phrase) - 1)
            base.add(BASE[phrase])
        elif phrase in NOTICES:
            labels.add(NOTICES[phrase])
        else:
            tagged = True
    values = [worth(x) for x in base | labels]
    for said in expressions(raw) if tagged else []:
        value, names = evaluate(leading(said))
        labels |= names
        values.append(value)
    return {
        "n_words": len(words),
        "n_base": n_base,
        "first_word": flat.count(" ", 0, min(starts)) if starts else None,
        "last_word": flat.count(" ", 0, max(starts)) if starts else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | labels)),
        "score": min(values, default=0.0),
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_ARROW = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _run(batches):
    for batch in batches:
        for a, b, data, offs in blocks(batch.column("text")):
            raw = data.tobytes()
            found = pa.RecordBatch.from_pylist([scan(raw[x:y]) for x, y in zip(offs[:-1], offs[1:])], _ARROW)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *found.columns], ["doc_id", *found.schema.names])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts and places of base phrases, labels, and the worth of all statements."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
