"""Licence scans: Aho-Corasick over words, and a shunting-yard parser for licence expressions.

Texts are lower-cased (A-Z only) and reduced to words joined by single spaces; one automaton finds
all phrases and identifier tags in a single pass. Expressions come from two places and are turned to
postfix form and evaluated alike. Behind an identifier tag the raw text holds one
(``MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND BSD-3-Clause)``). And the phrases found are
operands themselves: what stands between neighbours, if it is nothing but operators, parentheses and
words without weight (``under the MIT license or (the ISC license and CC0)``), joins them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: More notices: phrase, label and weight of evidence.
NOTICES = {
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "boost software license": ("bsl-1", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd 2 clause": ("bsd", 0.8),
    "bsd 3 clause": ("bsd", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "isc license": ("isc", 0.8),
    "the unlicense": ("unlicense", 0.8),
    "released into the public domain": ("public-domain", 0.7),
    "creative commons attribution": ("cc-by", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc0": ("cc0", 0.7),
    "all rights reserved": ("all-rights-reserved", 0.6),
}
BASE_WEIGHT, TAG_WEIGHT = 0.9, 1.0
TAG = "spdx license identifier"
#: Words between two notices that join them no less for being there.
FILLERS = frozenset("a an any both either it its of terms that the these this under version later 0 1 2 3 license licenses licence licences".split())
#: Labels of notices that allow reuse without conditions on the whole.
PERMISSIVE = ("mit", "apache-2", "bsd", "isc", "bsl-1", "unlicense", "public-domain", "cc0", "cc-by")
_TAG_AT = re.compile(r"spdx[^0-9a-z]+license[^0-9a-z]+identifier\s*:?[ \t]*", re.I | re.A)
_TOKEN = re.compile(r"[()\r\n]|[A-Za-z0-9][A-Za-z0-9.+:\-]*")
_JOINT = re.compile("[()]|[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def to_postfix(expression: str, at: int = 0, end: int | None = None) -> list[str] | None:
    """Postfix tokens of the licence expression at ``at``; None if malformed.

    Prose after the expression ends it, as does the line's end outside parentheses.
    """
    found = _TOKEN.finditer(expression, at, len(expression) if end is None else end)
    return shunt(m.group() for m in found)


def shunt(tokens: Iterable[str]) -> list[str] | None:
    """The shunting-yard algorithm: ``with`` binds closest, then ``and``, then ``or``; all are
    left-associative. No more tokens are taken than the expression has."""
    out: list[str] = []
    ops: list[str] = []
    operand_next = True
    for token in tokens:
        low = token.lower()
        if token in "\r\n":
            if "(" not in ops:
                break
            continue
        if operand_next:
            if token == "(":
                ops.append(token)
            elif token == ")" or low in _PRECEDENCE:
                return None
            else:
                out.append(token)
                operand_next = False
        elif token == ")":
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                break
            ops.pop()
        elif low in _PRECEDENCE:
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            operand_next = True
        else:
            break
    if operand_next or "(" in ops:
        return None
    return out + ops[::-1]


_ALLOWED = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "unlicense", "cc0-1.0", "zlib", "bsl-1.0")


def evaluate(postfix: list[str], allowed=_ALLOWED) -> tuple[set[str], bool]:
    """Licence ids named (lower case, ``id with exception`` as one) and whether some choice uses
    allowed licences only: ``or`` needs one side, ``and`` both, ``with`` the licence itself."""
    stack: list[tuple[set[str], bool]] = []
    for token in postfix:
        if token in _PRECEDENCE:
            (b, b_ok), (a, a_ok) = stack.pop(), stack.pop()
            if token == "with":
                stack.append(({f"{x} with {y}" for x in a for y in b}, a_ok))
            else:
                more, less = (a, b) if len(a) >= len(b) else (b, a)
                more |= less  # in place: an expression may name very many
                stack.append((more, a_ok or b_ok if token == "or" else a_ok and b_ok))
        else:
            low = token.lower().rstrip(".")
            stack.append(({low}, low in allowed))
    return stack[0]


def automaton():
    auto = ahocorasick.Automaton()
    found: dict[str, list] = {}
    for phrase, label in BASE.items():
        found.setdefault(phrase, []).append((True, label, BASE_WEIGHT))
    for phrase, (label, weight) in NOTICES.items():
        found.setdefault(phrase, []).append((False, label, weight))
    found.setdefault(TAG, []).append((False, None, TAG_WEIGHT))
    for phrase, what in found.items():
        auto.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, what))
    auto.make_automaton()
    return auto


def _joined(low: str, hits: list[tuple[int, int, str]]) -> list[list[str]]:
    """Expressions, as lists of tokens, over the hits (first word, words, label) of the text ``low``."""
    hits = sorted(hits, key=lambda h: (h[0], -h[1]))
    apart, free = [], 0
    for first, n, label in hits:  # the leftmost and longest of hits that overlap
        if first >= free:
            apart.append((first, n, label))
            free = first + n
    if len(apart) < 2:
        return [[label] for *_, label in apart]
    spans = [m.span() for m in _WORD.finditer(low)]
    out = [[apart[0][2]]]
    opened = _opened(low[max(0, spans[apart[0][0]][0] - 8) : spans[apart[0][0]][0]])
    out[0] = ["("] * opened + out[0]
    for (first, n, _), (then, _, label) in zip(apart, apart[1:], strict=False):
        gap = [x for x in _JOINT.findall(low, spans[first + n - 1][1], spans[then][0]) if x not in FILLERS]
        words = [x for x in gap if x not in "()"]
        if len(words) == 1 and words[0] in _PRECEDENCE:
            out[-1] += [*gap, label]
        else:
            out.append([*["("] * _opened("".join(x for x in gap if x in "()")), label])
    return out


def _opened(text: str) -> int:
    """Parentheses at the end of ``text`` that are still open."""
    return len(text) - len(text.rstrip().rstrip("(")) - (len(text) - len(text.rstrip()))


def _balanced(tokens: list[str]) -> list[str]:
    """Without closing parentheses that nothing opens and opening ones that nothing closes."""
    keep, open_at = [True] * len(tokens), []
    for i, t in enumerate(tokens):
        if t == "(":
            open_at.append(i)
        elif t == ")":
            if open_at:
                open_at.pop()
            else:
                keep[i] = False
    for i in open_at:
        keep[i] = False
    return [t for t, k in zip(tokens, keep, strict=True) if k]


def scan_text(auto, text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive)."""
    low = (text or "").encode().lower().decode()  # bytes.lower() changes A-Z only
    words = _WORD.findall(low)
    line = f" {' '.join(words)} "
    hits: list[tuple[int, int, str]] = []  # (place in the line, words, label)
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    miss, tagged = 1.0, False
    for end, (length, n, what) in auto.iter(line):
        at = end - length + 1
        for is_base, label, weight in what:
            if label is None:
                tagged = True
                continue
            hits.append((at, n, label))
            if is_base:
                starts.append(at)
                base.add(label)
            if label not in labels:
                labels.add(label)
                miss *= 1.0 - weight
    # the word that begins behind the space at a place is as many as there are spaces before
    number, seen, last_at = {}, 0, 0
    for at, *_ in sorted(hits):
        seen += line.count(" ", last_at, at)
        last_at = at
        number[at] = seen
    expressions: list[str] = []
    permissive = None

    def add(postfix: list[str], ok: bool) -> None:
        nonlocal permissive
        expressions.append(" ".join(postfix))
        permissive = ok if permissive is None else permissive and ok

    for tokens in _joined(low, [(number[at], n, label) for at, n, label in hits]):
        postfix = shunt(_balanced(tokens))
        if postfix is not None:
            add(postfix, evaluate(postfix, PERMISSIVE)[1])
    if tagged:
        tags = [m.span() for m in _TAG_AT.finditer(text or "")]
        for (_, at), (following, _) in zip(tags, [*tags[1:], (len(text or ""), 0)], strict=True):
            postfix = to_postfix(text, at, following)
            if postfix is None:
                continue
            ids, ok = evaluate(postfix)
            labels |= {f"spdx:{x}" for x in ids}
            miss *= 1.0 - TAG_WEIGHT
            add(postfix, ok)
    first = number[min(starts)] if starts else None
    last = number[max(starts)] if starts else None
    return (len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - miss, expressions, permissive)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean"
_ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permissive", pa.bool_())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licence columns) of every row, read from its whole text.

    Null and empty texts have no words, no labels and score 0; repeated rows give repeated results;
    an id may be null. ``score`` is the noisy-or of the evidence: 1 minus the product of (1 - weight)
    over distinct labels. Malformed expressions give no label. Only id and text are read, so extra
    columns of any name don't matter.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for batch in batches:
            rows = [scan_text(auto, t) for t in batch.column(1).to_pylist()]
            columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *[f.name for f in _ARROW]])

    out = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs)
