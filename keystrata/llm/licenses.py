"""License scans: Aho-Corasick finds identifier tags and notice phrases; a shunting-yard parser reads expressions."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from keystrata.llm.common import WORD_BYTES, per_text

# Phrases of words, and the labels they stand for.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PHRASES = {
    "affero general public license": "agpl",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "bsd license": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "eclipse public license": "epl",
    "gnu general public license": "gpl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "under the terms of the unlicense": "unlicense",
}
NOTICES = ("copyright c", "distributed under the", "is licensed under", "licensed under", "licence", "license", "released under the", "copyright")
PERMISSIVE = {"0bsd", "apache", "apache-2.0", "artistic", "bsd", "bsd-2-clause", "bsd-3-clause", "bsl", "bsl-1.0", "cc-by", "cc-by-4.0", "cc0", "cc0-1.0", "isc", "mit", "public-domain", "unlicense", "zlib"}
TAG = "spdx license identifier"
# End of fixed values.

TAG_VALUE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([A-Za-z0-9.+\-:/() \t]+)", re.IGNORECASE)
TOKEN = re.compile(r"[()]|[A-Za-z0-9](?:[A-Za-z0-9.\-:/]*[A-Za-z0-9])?\+?")
PRIORITY = {"or": 1, "and": 2, "with": 3}
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, expressions array<string>, permissive boolean, score double"


def postfix(expression: str) -> list[str] | None:
    """The longest well-formed head of a licence expression in postfix order; None if it has none.

    A tag's line may go on with prose: the head ends where an operand follows an operand."""
    out: list[str] = []
    ops: list[str] = []
    # best: how much of out the head has, and the operators that are still to come.
    want_operand, best, n_open = True, None, 0
    for m in TOKEN.finditer(expression):
        low = m[0].lower()
        if want_operand:
            if low == "(":
                ops.append(low)
                n_open += 1
            elif low in PRIORITY or low == ")":
                break
            else:
                out.append(low)
                want_operand = False
        elif low in PRIORITY:
            while ops and ops[-1] != "(" and PRIORITY[ops[-1]] >= PRIORITY[low]:
                out.append(ops.pop())
            ops.append(low)
            want_operand = True
            continue
        elif low == ")" and n_open:
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            n_open -= 1
        else:
            break
        if not want_operand and not n_open:
            best = len(out), ops[::-1]
    return out[: best[0]] + best[1] if best else None


def evaluate(post: list[str]) -> tuple[set[str], bool]:
    """Licences of an expression, and whether it can be met with permissive ones: either side of an or, both of an and.
    An exception after with is no licence and only widens what it is put on."""
    stack: list[tuple[set[str], bool]] = []
    for token in post:
        if token in PRIORITY:
            (b, b_ok), (a, a_ok) = stack.pop(), stack.pop()
            if token != "with":
                a |= b
                a_ok = a_ok or b_ok if token == "or" else a_ok and b_ok
            stack.append((a, a_ok))
        else:
            stack.append(({token}, token.rstrip("+") in PERMISSIVE))
    return stack[0]


_cache: dict[int, ahocorasick.Automaton] = {}


def automaton() -> ahocorasick.Automaton:
    if 0 not in _cache:
        values: dict[str, list] = {}
        for p, label in BASE.items():
            values.setdefault(p, []).append(("base", label))
        for p, label in PHRASES.items():
            values.setdefault(p, []).append(("phrase", label))
        for p in NOTICES:
            values.setdefault(p, []).append(("notice", ""))
        values.setdefault(TAG, []).append(("tag", ""))
        a = ahocorasick.Automaton()
        for p, found in values.items():
            a.add_word(f" {p} ", (len(p.split()), found))
        a.make_automaton()
        _cache[0] = a
    return _cache[0]


def examine(text: str | None) -> tuple:
    """What a text says of its licence; see scan_licenses."""
    words = text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []
    if not words:
        return 0, 0, None, None, "", "", [], None, 0.0
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    starts: list[int] = []
    base, labels, kinds, ends = set(), set(), set(), None
    for at, (k, found) in automaton().iter(line):
        for kind, label in found:
            kinds.add(kind)
            if kind == "base":
                ends = ends or list(accumulate(len(x) + 1 for x in words))
                starts.append(bisect_left(ends, at) - k + 1)
                base.add(label)
            elif label:
                labels.add(label)
    labels |= base
    expressions, oks = [], []
    if "tag" in kinds:
        for m in TAG_VALUE.finditer(text):
            if post := postfix(m[1]):
                named, ok = evaluate(post)
                labels |= named
                expressions.append(" ".join(post))
                oks.append(ok)
    permissive = all(oks) if oks else labels <= PERMISSIVE if labels else None
    # Independent signs of a licence, put together: 1 - product of their doubts.
    doubt = 1.0
    for sign, weight in (("base", 0.8), ("phrase", 0.9), ("notice", 0.3)):
        doubt *= 1 - weight * (sign in kinds)
    doubt *= 1 - 0.95 * bool(expressions)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), expressions, permissive, round(1 - doubt, 6)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, `keep` columns, n_words, n_base, first_word, last_word, base_labels, labels,
    expressions, permissive, score.

    Words as in the scan for benchmark items. n_base counts the places of base phrases, first_word and last_word are
    their smallest and largest start (null without any). labels adds those of further phrases and of the expressions
    after identifier tags, read to the end of the tag's line. expressions are in postfix order. permissive: every tagged expression can be met with
    permissive licences; without tags, all labels are permissive; null without labels. score: 1 less the product of
    the doubts that each kind of sign leaves; 0 without a sign. A null or empty text has no words and no labels, its
    label columns are empty strings. An empty table gives no rows. Labels that are found twice are listed once, in sorted order, so there
    are no ties. Other columns aren't read; a kept one that is named like a result gets _in appended. Rows are judged alone
    where they are read, in time in proportion to the text's length; repeated rows stay repeated."""

    def work(texts):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.float64())
        rows = [examine(t) for t in texts]
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    return per_text(docs, work, SCHEMA, id_col, text_col, keep)
