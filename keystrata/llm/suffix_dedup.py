"""Exact removal of repeated byte strings by prefix-free parsing.

A rolling hash picks triggers: in every window of LENGTH bytes the first of the TRIGGER-byte strings with the least
hash. (Triggers by a fixed modulus would leave windows without one.) A phrase is a stretch of window starts that
share a trigger, with all bytes of their windows. Which trigger a window has follows from its bytes alone, so equal
windows have equal triggers at equal places: windows of phrases with different triggers are never equal, which is what
prefix-free parsing needs at this depth. So:

1. Parse. Phrases go to buckets by trigger as digests. Of equal phrases all but the first are repeats as a whole.
   Phrases whose trigger stands in other phrases too are open; most phrases of plain text are neither.
2. Open phrases go to buckets by trigger as text. Cut at its trigger, a phrase is two words of the bucket's dictionary: a
   left word, which ends with the trigger, and a right word, which begins with it. A window is a suffix of the one,
   longer than the trigger, and what follows in the parse: the other to the depth of LENGTH. The suffixes of the
   dictionary are sorted with their common lengths; both orders together put the windows of the bucket in corpus order,
   equal ones side by side, which bytes decide. All but the first of those are repeats.
3. Documents drop the bytes that repeats cover.

Triggers with very many phrases are hot: their phrases are cut into intervals of window starts, and each interval goes to
the bucket of the bytes that all its windows share, after windows that repeat inside a task are gone. Text crosses the
network twice, compressed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import cut, evened, input_bytes, keyed, map_arrow, original_id, text_bytes
from keystrata.llm.rolling import BASE, BYTE_VALUES, mix, prefix_sums, range_hashes, window_hashes

LENGTH = 100
TRIGGER = 32
#: Bytes parsed at once.
STRIDE = 1 << 20
#: Text of a block: what is combined before it leaves a task.
BLOCK_BYTES = 48 << 20
#: Input for which one bucket is provided.
BUCKET_INPUT = 4 << 20
#: Phrases with which a trigger is hot, at least; for much input more, so that hot triggers are at most a few millions.
HOT, HOT_SHARE = 4096, 1 << 26

_AT = np.uint64((1 << 24) - 1)


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours: from the running minima of blocks, forwards and backwards."""
    n = len(key) - width + 1
    padded = np.full(-(-len(key) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def phrases(buffer: np.ndarray, first: np.ndarray, last: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER) -> tuple[np.ndarray, ...]:
    """Of texts buffer[first[i]:last[i]] that follow on each other: start, count of windows, place of the trigger after the
    start, trigger hash, phrase hash."""
    none = np.zeros(0, dtype=np.int64)
    if len(buffer) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_sums(buffer)
    hashes = window_hashes(sums, trigger)
    least = sliding_least((hashes & ~_AT) | np.arange(len(hashes), dtype=np.uint64), length - trigger + 1)
    change = np.zeros(len(buffer) + 1, dtype=np.int8)
    np.add.at(change, first, 1)
    np.add.at(change, np.maximum(first, last - length + 1), -1)
    inside = np.cumsum(change[: len(least)]).astype(bool)
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    stop = np.ones(len(least), dtype=bool)
    stop[:-1] = (least[1:] != least[:-1]) | ~inside[1:]
    end = np.flatnonzero(stop & inside) + 1
    at = (least[start] & _AT).astype(np.int64)
    return start, end - start, at - start, hashes[at], range_hashes(sums, start, end - 1 + length)


def parse(texts: list[bytes], length: int = LENGTH, stride: int = STRIDE) -> tuple[np.ndarray, ...]:
    """text number, start in it, count, place of the trigger, trigger, phrase. A longer text is parsed in parts that overlap by length - 1:
    a phrase that a border cuts is two phrases with one trigger."""
    out: list[tuple[np.ndarray, ...]] = []
    batch: list[tuple[int, int, bytes]] = []
    room = stride

    def flush() -> None:
        nonlocal room
        if batch:
            sizes = np.array([len(b) for _, _, b in batch])
            first = np.cumsum(sizes) - sizes
            start, *rest = phrases(np.frombuffer(b"".join([b for _, _, b in batch]), dtype=np.uint8), first, first + sizes, length)
            which = np.searchsorted(first, start, side="right") - 1
            out.append((np.array([i for i, _, _ in batch])[which], start - first[which] + np.array([o for _, o, _ in batch])[which], *rest))
        batch.clear()
        room = stride

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), stride):
            part = text[at : at + stride + length - 1]
            if len(part) < length:
                continue
            if len(part) > room:
                flush()
            batch.append((i, at, part))
            room -= len(part)
    flush()
    if not out:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sorted_words(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of a byte matrix, and how many first bytes each has in common with the one before in it."""
    n, width = words.shape
    order = np.argsort(np.ascontiguousarray(words).view(f"S{width}").ravel(), kind="stable")
    s = words[order]
    common = np.zeros(n, dtype=np.int64)
    differ = s[1:] != s[:-1]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


def _cells(buffer: np.ndarray, at: np.ndarray, step: np.ndarray, begin: np.ndarray, end: np.ndarray, rows: int = 1 << 14) -> np.ndarray:
    """buffer[at[i] + step[j]], 0 outside of begin[i] and end[i]; a part of the rows at a time."""
    out = np.zeros((len(at), len(step)), dtype=np.uint8)
    for i in range(0, len(at), rows):
        part = slice(i, i + rows)
        places = at[part, None] + step
        inside = (places >= begin[part, None]) & (places < end[part, None])
        out[part][inside] = buffer[places[inside]]
    return out


class Dictionary:
    """The words of phrases that are cut at their triggers. Left words are read backwards from the trigger, so that an order of
    them is one of all their suffixes at once; right words go to the depth of a window. Words are filled up with zeros:
    where two agree to a depth that both have, so does all that stands between them."""

    def __init__(self, buffer: np.ndarray, begin: np.ndarray, count: np.ndarray, lead: np.ndarray, length: int = LENGTH, trigger: int = TRIGGER):
        self.n, self.length, self.reach = len(begin), length, length - trigger
        self.count, self.lead = count, lead
        end = begin + count - 1 + length
        self.right = sorted_words(_cells(buffer, begin + lead, np.arange(length), begin, end))
        self.left = sorted_words(_cells(buffer, begin + lead - 1, -np.arange(max(1, self.reach)), begin, end))

    def ranks(self, side: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
        """The rank of every phrase's word among the first `depth` bytes of all; equal for equal ones."""
        order, common = side
        out = np.empty(self.n, dtype=np.int64)
        out[order] = np.cumsum(common < depth)
        return out

    def windows(self):
        """For every place of a trigger in a window: the phrases that have such a window, the start in each, and ranks that
        are equal for equal windows."""
        for d in range(self.reach + 1):
            some = np.flatnonzero((self.lead >= d) & (self.lead - d < self.count))
            if len(some):
                yield some, self.lead[some] - d, (self.ranks(self.left, d) * (self.n + 1) + self.ranks(self.right, self.length - d))[some]


def repeated(d: Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """Phrase, and start in it, of every window that equals one of an earlier phrase."""
    phrase, inner = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for some, start, rank in d.windows():
        order = np.argsort(rank, kind="stable")
        s = rank[order]
        again = order[1:][s[1:] == s[:-1]]
        phrase.append(some[again])
        inner.append(start[again])
    return np.concatenate(phrase), np.concatenate(inner)


def groups_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by the keys, the first of them counting most, and which places begin a new group."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = False
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, new


class Block:
    """Texts of one task, with their row keys, put into the order of those keys."""

    def __init__(self):
        self.rid, self.rk, self.texts, self.bytes = [], [], [], 0

    def add(self, rid: int, rk: int, text: bytes) -> None:
        self.rid.append(rid)
        self.rk.append(rk)
        self.texts.append(text)
        self.bytes += len(text)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rid, rk and the rank of each text."""
        rid, rk = np.array(self.rid, dtype=np.int64), np.array(self.rk, dtype=np.int32)
        rank = np.empty(len(rid), dtype=np.int64)
        rank[np.lexsort((rk, rid))] = np.arange(len(rid))
        return rid, rk, rank


#: Rows between the steps: arrays of places. Kind MEETS goes to the bucket of its key; GONE repeats; OPEN is open.
PLACES = "kind int, bucket int, key binary, text binary, rid binary, rk binary, start binary, count binary, lead binary"
#: Rows for documents. Those of kind HOT tell of a trigger: its bucket is rk, its key rid.
SPANS = "rid long, rk int, start int, count int, lead int, kind int"
GONE, OPEN, MEETS, HOT_KEY = 0, 1, 2, 3
_FIELDS = (("key", np.uint32), ("text", np.uint64), ("rid", np.int64), ("rk", np.int32), ("start", np.int32), ("count", np.int32), ("lead", np.uint8))
#: A trigger that is open, whatever its phrase; its count is that of its phrases.
_MARK = np.uint64(0)


class Places:
    """Stretches of window starts in documents: count starts from start on; with the key and digest of their text, and the
    place of their trigger after the start."""

    def __init__(self, rid, rk, start, count, lead=None, key=None, text=None):
        n = len(rid)
        self.rid, self.rk, self.start, self.count = rid, rk, start, count
        self.lead = np.zeros(n, dtype=np.int64) if lead is None else lead
        self.key = np.zeros(n, dtype=np.uint32) if key is None else key
        self.text = np.zeros(n, dtype=np.uint64) if text is None else text

    def take(self, which: np.ndarray) -> Places:
        return Places(self.rid[which], self.rk[which], self.start[which], self.count[which], self.lead[which], self.key[which], self.text[which])

    def joined(self) -> Places:
        """In document order, with stretches that touch or overlap as one."""
        p = self.take(np.lexsort((self.start, self.rk, self.rid)))
        if not len(p.rid):
            return p
        doc = np.ones(len(p.rid), dtype=bool)
        doc[1:] = (p.rid[1:] != p.rid[:-1]) | (p.rk[1:] != p.rk[:-1])
        far = np.int64(1) << np.int64(33)
        base = np.cumsum(doc).astype(np.int64) * far
        reach = np.maximum.accumulate(base + p.start + p.count)
        new = doc.copy()
        new[1:] |= (base + p.start)[1:] > reach[:-1]
        at = np.flatnonzero(new)
        end = reach[np.append(at[1:], len(new)) - 1] - base[at]
        return Places(p.rid[at], p.rk[at], p.start[at], end - p.start[at])

    def rows(self, kind: int, bucket: np.ndarray) -> list[tuple]:
        """A row for every bucket; documents in order and as differences inside it, so that it compresses well."""
        order = np.lexsort((self.start, self.rk, self.rid, bucket))
        if not len(order):
            return []
        cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            p = self.take(order[a:b])
            p.rid, p.start = np.diff(p.rid, prepend=0), np.diff(p.start, prepend=0)
            out.append((kind, int(bucket[order[a]]), *(np.ascontiguousarray(getattr(p, f), dtype=t).tobytes() for f, t in _FIELDS)))
        return out

    @staticmethod
    def read(table: pa.Table) -> Places:
        got = {}
        for name, kind in _FIELDS:
            arrays = [np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]
            if name in ("rid", "start"):
                arrays = [np.cumsum(x) for x in arrays]
            got[name] = np.concatenate(arrays) if arrays else np.zeros(0, dtype=kind)
        return Places(**got)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * len(_FIELDS))
    names = ["kind", "bucket", *(f for f, _ in _FIELDS)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _runs(new: np.ndarray) -> np.ndarray:
    """The size of each row's group, where `new` marks the first of every group."""
    return np.diff(np.append(np.flatnonzero(new), len(new)))[np.cumsum(new) - 1]


def _spread(p: Places, buckets: int) -> np.ndarray:
    """Buckets for what meets nothing, so that all get some."""
    return (p.rid * 40503 + p.start) % buckets


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the way to where their spans are; half the size of what a shuffle makes of them."""
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        packed = [None if t is None else press.compress(t.encode("utf-8", "replace")) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("rk"), pa.array(packed, pa.binary())], names=["rid", "rk", "packed"])


def _unpack(packed: list[bytes | None]) -> list[bytes | None]:
    press = zstandard.ZstdDecompressor()
    return [None if p is None else press.decompress(p) for p in packed]


def _texts(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[Block]:
    block = Block()
    for b in batches:
        for rid, rk, text in zip(b.column("rid").to_pylist(), b.column("rk").to_pylist(), b.column("text").to_pylist(), strict=True):
            block.add(rid, rk, text.encode("utf-8", "replace") if text else b"")
            if block.bytes >= block_bytes:
                yield block
                block = Block()
    if block.texts:
        yield block


def _first_step(buckets: int, length: int, block_bytes: int):
    """Parses. Of a block's equal phrases one stays. A trigger with several phrases in a block is open, and its bucket
    is told so by one mark, whatever their number."""

    def work(batches):
        for block in _texts(batches, block_bytes):
            rid, rk, rank = block.keys()
            which, start, count, lead, trig, phrase = parse(block.texts, length)
            phrase |= np.uint64(1)
            order, new = groups_of(trig, phrase)
            order = order[np.lexsort((start[order], rank[which[order]], np.cumsum(new)))]
            every = Places(rid[which], rk[which], start, count, lead, (trig & np.uint64(0xFFFFFFFF)).astype(np.uint32), phrase)
            firsts = order[new]
            t = trig[firsts]
            head = np.ones(len(t), dtype=bool)
            head[1:] = t[1:] != t[:-1]
            size = _runs(head) if len(head) else np.zeros(0, dtype=np.int64)
            gone, opened = every.take(order[~new]).joined(), every.take(firsts[size > 1])
            rows = gone.rows(GONE, _spread(gone, buckets)) + opened.rows(OPEN, _spread(opened, buckets))
            alone, marks = firsts[size == 1], firsts[(size > 1) & head]
            every.text[marks] = _MARK
            every.count[marks] = size[(size > 1) & head]
            sent = np.concatenate((alone, marks))
            yield _batch(rows + every.take(sent).rows(MEETS, _bucket(trig[sent], buckets)))

    return work


def _digests(buffer: np.ndarray, at: np.ndarray, width: int, rows: int = 1 << 13) -> np.ndarray:
    """As `window_hashes`, at some places only; a part of them at a time."""
    up = BASE ** np.arange(width, dtype=np.uint64)
    out = np.empty(len(at), dtype=np.uint64)
    for i in range(0, len(at), rows):
        out[i : i + rows] = (BYTE_VALUES[buffer[at[i : i + rows, None] + np.arange(width)]] * up).sum(axis=1, dtype=np.uint64)
    return mix(out)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _spans(parts: list[tuple[int, Places]]) -> pa.Table:
    at = {f: np.concatenate([getattr(p, f) for _, p in parts]) for f in ("rid", "rk", "start", "count", "lead")}
    kind = np.concatenate([np.full(len(p.rid), k) for k, p in parts])
    types = {"rid": pa.int64(), "rk": pa.int32(), "start": pa.int32(), "count": pa.int32(), "lead": pa.int32()}
    return pa.table({**{f: pa.array(at[f].astype(np.int64), pa.int64()).cast(t) for f, t in types.items()}, "kind": pa.array(kind, pa.int32())})


def _meet(hot: int):
    """A bucket of phrases. All but the first of the places with one key and text repeat. The first ones are open if their key
    has other texts or a mark. A key with `hot` phrases or more, each block's counted for itself, is told of."""

    def work(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        p, gone, opened = (Places.read(table.filter(pa.array(kind == k))) for k in (MEETS, GONE, OPEN))
        out = [(GONE, gone), (OPEN, opened)]
        if len(p.rid):
            order = np.lexsort((p.start, p.rk, p.rid, p.text, p.key))
            k, t = p.key[order], p.text[order]
            key, new = np.ones(len(order), dtype=bool), np.ones(len(order), dtype=bool)
            key[1:] = k[1:] != k[:-1]
            new[1:] = key[1:] | (t[1:] != t[:-1])
            mark = t == _MARK
            at, group = np.flatnonzero(key), np.cumsum(key) - 1
            alone = np.add.reduceat((new & ~mark).astype(np.int64), at)
            marked = np.add.reduceat(np.where(mark, p.count[order], 0), at)
            out.append((GONE, p.take(order[~new & ~mark]).joined()))
            out.append((OPEN, p.take(order[new & ~mark & ((alone > 1) | (marked > 0))[group]])))
            many = at[alone + marked >= hot]
            zero = np.zeros(len(many), dtype=np.int64)
            out.append((HOT_KEY, Places(k[many].astype(np.int64), np.full(len(many), table.column("bucket")[0].as_py()), zero, zero)))
        return _spans(out)

    return work


def intervals(length: int, trigger: int) -> list[tuple[int, int]]:
    """The places of a trigger in a window, 0 to length - trigger, in intervals that grow towards the middle."""
    last = length - trigger
    edges = sorted({0, last + 1, *(x for i in range(last.bit_length()) for x in (1 << i, last + 1 - (1 << i)) if (1 << i) <= last // 2 + 1)})
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]


#: Open phrases on their way to a bucket; of kind GONE without text.
OPENED = "kind int, bucket int, rid binary, rk binary, start binary, count binary, lead binary, text binary"
_OPENED = tuple(f for f in _FIELDS if f[0] not in ("key", "text"))


def _second_step(buckets: int, length: int, block_bytes: int, hot_keys, trigger: int = TRIGGER):
    """Sends a block's open phrases to the bucket of their trigger, with their text. Windows of hot triggers that repeat
    inside the block are gone here; the others go to the bucket of what their interval's windows share."""

    def batch(rows: list[tuple[int, Places, np.ndarray, np.ndarray, bytes]]) -> pa.RecordBatch:
        out: list[tuple] = []
        for kind, p, bucket, begin, data in rows:
            order = np.lexsort((p.start, p.rk, p.rid, bucket))
            if not len(order):
                continue
            cuts = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                q, at = p.take(order[a:b]), begin[order[a:b]].tolist()
                text = b"".join([data[x : x + c + length - 1] for x, c in zip(at, q.count.tolist(), strict=True)]) if kind == OPEN else None
                out.append((kind, int(bucket[order[a]]), *(np.ascontiguousarray(getattr(q, f), dtype=t).tobytes() for f, t in _OPENED), text))
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 6)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["kind", "bucket", *(f for f, _ in _OPENED), "text"])

    def work(batches):
        hot = hot_keys.value
        for p, begin, data in _opened(batches, block_bytes):
            buffer = np.frombuffer(data, dtype=np.uint8)
            at = begin + p.lead
            trig = _digests(buffer, at, trigger)
            bucket = _bucket(trig, buckets)
            is_hot = np.isin((bucket.astype(np.uint64) << np.uint64(32)) | (trig & np.uint64(0xFFFFFFFF)), hot)
            rows = [(OPEN, p.take(~is_hot), bucket[~is_hot], begin[~is_hot], data)]
            if is_hot.any():
                h, hb = p.take(is_hot), begin[is_hot]
                order = np.lexsort((h.start, h.rk, h.rid))
                h, hb = h.take(order), hb[order]
                which, inner = repeated(Dictionary(buffer, hb, h.count, h.lead, length, trigger))
                gone = Places(h.rid[which], h.rk[which], h.start[which] + inner, np.ones(len(which), dtype=np.int64)).joined()
                rows.append((GONE, gone, _spread(gone, buckets), gone.start, data))
                base = np.cumsum(h.count) - h.count
                stays = np.ones(int(h.count.sum()), dtype=np.int64)
                stays[base[which] + inner] = 0
                left = np.concatenate(([0], np.cumsum(stays)))
                for low, high in intervals(length, trigger):
                    first, last = np.maximum(0, h.lead - high), np.minimum(h.count - 1, h.lead - low)
                    some = np.flatnonzero(first <= last)
                    some = some[left[(base + last)[some] + 1] > left[(base + first)[some]]]
                    if not len(some):
                        continue
                    f, t = first[some], hb[some] + h.lead[some]
                    q = Places(h.rid[some], h.rk[some], h.start[some] + f, last[some] - f + 1, h.lead[some] - f)
                    rows.append((OPEN, q, _bucket(_digests(buffer, t - low, low - high + length) + np.uint64(low << 32), buckets), hb[some] + f, data))
            yield batch(rows)

    return work


def _opened(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[Places, np.ndarray, bytes]]:
    """The open phrases of documents, where they begin in the documents' bytes, and those bytes, block by block."""
    parts: list[tuple] = []
    texts: list[bytes] = []
    size = 0

    def block():
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        return Places(*cols[:5]), cols[5], b"".join(texts)

    for b in batches:
        spans = b.column("spans")
        at = spans.offsets.to_numpy().astype(np.int64)
        start, count, lead = (spans.values.field(f).to_numpy().astype(np.int64)[at[0] : at[-1]] for f in ("start", "count", "lead"))
        number = np.diff(at)
        some = _unpack(b.column("packed").to_pylist())
        sizes = np.array([len(t or b"") for t in some], dtype=np.int64)
        offset = size + np.cumsum(sizes) - sizes
        parts.append((*(np.repeat(b.column(c).to_numpy(), number) for c in ("rid", "rk")), start, count, lead, start + np.repeat(offset, number)))
        texts += [t or b"" for t in some]
        size += int(sizes.sum())
        if size >= block_bytes:
            yield block()
            parts, texts, size = [], [], 0
    if parts:
        yield block()


def _settle(length: int, trigger: int = TRIGGER):
    """A bucket of open phrases in corpus order: all but the first of equal windows repeat."""

    def read(table: pa.Table) -> Places:
        got = [np.concatenate([np.frombuffer(x, dtype=t) for x in table.column(f).to_pylist()] or [np.zeros(0, dtype=t)]).astype(np.int64) for f, t in _OPENED]
        return Places(*got)

    def work(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        gone, opened = (table.filter(pa.array(kind == k)) for k in (GONE, OPEN))
        out = [(GONE, read(gone))]
        p = read(opened)
        if len(p.rid) > 1:
            buffer = np.frombuffer(b"".join(opened.column("text").to_pylist()), dtype=np.uint8)
            size = p.count + length - 1
            begin = np.cumsum(size) - size
            order = np.lexsort((p.start, p.rk, p.rid))
            p = p.take(order)
            which, inner = repeated(Dictionary(buffer, begin[order], p.count, p.lead, length, trigger))
            out.append((GONE, Places(p.rid[which], p.rk[which], p.start[which] + inner, np.ones(len(which), dtype=np.int64)).joined()))
        return _spans(out)

    return work


def cut_out(text: bytes, spans: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, list[tuple[int, int]]]:
    """The text without the windows that start in the spans [start, stop), and the maximal runs that are gone."""
    runs: list[list[int]] = []
    for s, e in sorted(spans):
        e += length - 1
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    at, kept = 0, []
    for s, e in runs:
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    return b"".join(kept), [(s, e) for s, e in runs]


def _third_step(length: int, with_text: bool):
    def work(batches):
        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}
        for b in batches:
            rows = []
            spans = b.column("spans")
            at = spans.offsets.to_pylist()
            start = spans.values.field("start").to_numpy()
            stop = start + spans.values.field("count").to_numpy()
            for i, text in enumerate(_unpack(b.column("packed").to_pylist())):
                data, runs = text or b"", []
                kept = data
                if at[i + 1] > at[i]:
                    kept, runs = cut_out(data, list(zip(start[at[i] : at[i + 1]].tolist(), stop[at[i] : at[i + 1]].tolist(), strict=True)), length)
                rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text and text is not None else None))
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("rk"), *made], names=["rid", "rk", *kinds])

    return work


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    with_text: bool = True,
    block_bytes: int = BLOCK_BYTES,
    bucket_input: int = BUCKET_INPUT,
    hot: int = HOT,
) -> DataFrame:
    """One row per document: id, rk, n_bytes, n_removed, n_spans, kept_sha256, kept (null unless with_text).

    Texts are UTF-8 bytes. A byte goes if a `length`-byte string that covers it also starts earlier: in a document with
    a smaller id, or in the same one. Strings are compared in the input; they don't cross documents. kept_sha256 is the
    digest of the bytes that are left; kept is them as text, without characters of which a part is gone. A null text has
    no bytes and stays null; shorter texts stay whole. Rows that share an id are told apart by rk, in the order of
    their text; a null id comes after all others. An empty table gives no rows. Other columns are not read. A text of any
    length is parsed in parts of a megabyte.

    Phrases count as equal if 64 bits of their trigger's digest and 64 bits of their own agree; windows of different phrases
    are compared byte by byte. `hot` is the number of phrases from which on a trigger is dealt out by its surroundings;
    the result is the same for all values of it, of block_bytes and of bucket_input."""
    spark = docs.sparkSession
    rows = evened(keyed(docs, id_col, text_col).select("rid", "rk", "text"))
    scanned = input_bytes(docs, text_col)
    buckets = text_bytes(scanned, bucket_input, 48)
    found = cut(map_arrow(rows, _first_step(buckets, length, block_bytes), PLACES).groupBy("bucket").applyInArrow(_meet(max(hot, scanned // HOT_SHARE)), SPANS))
    keys = found.filter(F.col("kind") == HOT_KEY).select("rk", "rid").collect()
    hot_keys = spark.sparkContext.broadcast(np.sort(np.array([(r["rk"] << 32) | r["rid"] for r in keys], dtype=np.uint64)))

    packed = map_arrow(rows, _pack, "rid long, rk int, packed binary")

    def by_document(spans: DataFrame, how: str) -> DataFrame:
        listed = spans.groupBy("rid", "rk").agg(F.collect_list(F.struct("start", "count", "lead")).alias("spans"))
        return packed.join(listed, ["rid", "rk"], how)

    opened = map_arrow(by_document(found.filter(F.col("kind") == OPEN), "inner"), _second_step(buckets, length, max(1, block_bytes // 8), hot_keys), OPENED)
    settled = cut(opened.groupBy("bucket").applyInArrow(_settle(length), SPANS))
    spans = found.filter(F.col("kind") == GONE).unionByName(settled)
    out = map_arrow(by_document(spans, "left"), _third_step(length, with_text), "rid long, rk int, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return out.select(original_id().alias(id_col), "rk", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
