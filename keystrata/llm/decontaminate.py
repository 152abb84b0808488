"""Benchmark decontamination: one Aho-Corasick automaton over the windows of normalised test items."""

from __future__ import annotations

import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keystrata.llm.common import WORD_BYTES, carry, evened, map_arrow, named, names_beside

WINDOW = 13
#: Text of the items that go into one automaton, which takes about 130 times that in a worker. More items are more automata,
#: one after the other over the same texts.
AUTOMATON_BYTES = 3 << 20
#: Text that is scanned before the next automaton is made, where there are several.
SCAN_BYTES = 64 << 20
ORIGINAL_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"

#: The automaton that a worker used last.
_automata: dict[tuple[str, int], Scanner] = {}


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


def windows(items: list[tuple[str | None, str | None]], size: int = WINDOW) -> dict[str, tuple[int, list[str]]]:
    """Window text -> (words in it, items that have it)."""
    found: dict[str, tuple[int, set]] = {}
    for item, text in items:
        w = words_of(text)
        k = min(size, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            found.setdefault((b" " + b" ".join(w[i : i + k]) + b" ").decode("latin-1"), (k, set()))[1].add(item)
    return {p: (k, sorted(x for x in who if x is not None)) for p, (k, who) in found.items()}


class Scanner:
    """An Aho-Corasick automaton whose letters are words: the numbers of those that windows have, 0 for all others."""

    def __init__(self, patterns: dict[str, tuple[int, list[str]]]):
        self.number: dict[bytes, int] = {}
        self.found = list(patterns.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, p in enumerate(patterns):
            self.automaton.add_word(tuple([self.number.setdefault(w, len(self.number) + 1) for w in p.encode("latin-1").split()]), i)
        self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Place of the last word, and number of the window, of every occurrence."""
        get = self.number.get
        return list(self.automaton.iter(tuple([get(w, 0) for w in words])))


def automaton(patterns: dict[str, tuple[int, list[str]]]) -> Scanner | None:
    return Scanner(patterns) if patterns else None


def scan(text: str | None, a: Scanner | None) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, hit ranges of words, items."""
    w = words_of(text)
    if a is None or not w:
        return len(w), [], set()
    ranges, items = [], set()
    for last, i in a.hits(w):
        k, who = a.found[i]
        ranges.append((last - k + 1, last + 1))
        items.update(who)
    return len(w), ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    at = [m.span() for m in ORIGINAL_WORD.finditer(text)]
    return [{"start": at[s][0], "end": at[e - 1][1]} for s, e in ranges]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: tuple[str, ...] = (),
    window: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """One row per document: id, `keep` columns, n_words, n_hit, items, spans.

    Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased. A window is `window`
    consecutive words of an item, or all words of a shorter one. items: ids of the items with a window in the
    document, as sorted strings. spans: maximal runs of hit words, as [start, end) code points of the original
    text. A null or empty text has no words and no hits. An item without words is never found; an item with a
    null id marks words but isn't listed; repeated rows of items count once, those of documents stay repeated. An empty
    benchmark hits nothing, an empty table of documents gives no rows. Of windows with equal words all items are listed. Other
    columns aren't read; a kept one that is named like a result gets _in appended.

    Documents are scanned where they are read, whole: nothing is shuffled. The items pass the driver one after the other and
    go to the executors as lists of at most `automaton_bytes` of text (a longer item alone); a worker holds the automaton of one list. Where there are several, a worker
    takes them in turn for SCAN_BYTES of text."""
    spark = docs.sparkSession
    casts: list = []
    some: list[tuple[str | None, str | None]] = []
    room = automaton_bytes
    rows = benchmark.select(named(item_col).cast("string").alias("i"), named(item_text_col).alias("t")).distinct()
    for r in rows.sort("i", "t").toLocalIterator():
        size = len(r["t"] or "")
        if some and size > room:
            casts.append(spark.sparkContext.broadcast(some))
            some, room = [], automaton_bytes
        some.append((r["i"], r["t"]))
        room -= size
    casts.append(spark.sparkContext.broadcast(some))
    run = uuid.uuid4().hex

    def load(k: int) -> Scanner | None:
        if (run, k) not in _automata:
            _automata.clear()
            _automata[run, k] = automaton(windows(casts[k].value, window))
        return _automata[run, k]

    def scanned(texts: list[str | None]) -> list[list]:
        found: list[list] = [[0, [], set()] for _ in texts]
        for k in range(len(casts)):
            a = load(k)
            for f, text in zip(found, texts, strict=True):
                f[0], ranges, items = scan(text, a)
                f[1] += ranges
                f[2] |= items
        return found

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def results(texts: list[str | None], found: list[list]) -> list[pa.Array]:
        n_hit, spans = [], []
        for f, text in zip(found, texts, strict=True):
            ranges = merged(f[1])
            n_hit.append(sum(e - s for s, e in ranges))
            spans.append(original_spans(text, ranges) if ranges else [])
        return [
            pa.array(np.array([f[0] for f in found], dtype=np.int64)),
            pa.array(np.array(n_hit, dtype=np.int64)),
            pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())),
            pa.array(spans, span),
        ]

    result = StructType.fromDDL(SCHEMA)
    carried = [id_col, *(c for c in dict.fromkeys(keep) if c != id_col)]
    given, fields = carry(docs, text_col, carried)

    def work(batches):
        """Several batches at a time, if there is more than one automaton to load."""
        held: list[pa.RecordBatch] = []
        size = 0

        def done():
            texts = [b.column(0).to_pylist() for b in held]
            found = scanned([t for x in texts for t in x])
            at = 0
            for b, x in zip(held, texts, strict=True):
                made = results(x, found[at : at + len(x)])
                at += len(x)
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1, b.num_columns)), *made], names=[*b.schema.names[1:], *result.names])

        for b in batches:
            held.append(b)
            size += b.nbytes
            if len(casts) == 1 or size >= SCAN_BYTES:
                yield from done()
                held, size = [], 0
        if held:
            yield from done()

    out = map_arrow(evened(given), work, StructType([*fields, *result.fields]))
    return out.select(*(F.col(f.name).alias(n) for f, n in zip(fields, names_beside(carried, result.names), strict=True)), *result.names)


def contaminated():
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
