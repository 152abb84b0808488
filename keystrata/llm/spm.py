"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Adjacent symbols are merged in the order of their piece's score, leftmost first among equals. `encode_word`
keeps the candidate pairs on an agenda (a heap); `encode_words` advances the agendas of many words at once,
as matrices, one merge a word and step. Both are checked against the sentencepiece library."""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from keystrata.llm.common import per_text

SPACE = "▁"
#: A run of spaces with what follows, or a newline. No piece reaches over such a border, so these parts merge alone.
PART = re.compile(r" *[^ \n]+| +|\n")
#: Longer parts go to the heap: the matrices do a step for each symbol of the longest part.
LONG = 160
#: A worker remembers up to twice as many parts; about 250 bytes each.
REMEMBERED = 300_000
#: Of the texts of a batch, the first and then each so many are compared as a whole with the library.
WHOLE = 64
SCHEMA = "n_tokens long, ids string, decoded string"

_models: dict[str, Merges] = {}


class Merges:
    """The merge table of one model file."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto) if proto else sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces to fall back on")
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece reaches over the border between words")
        if sp.encode("a  B\tﬁ", out_type=str)[0][0] != SPACE or sp.decode(sp.encode(" a  B\tﬁ ")) != " a  B\tﬁ ":
            raise ValueError("only an identity normaliser with a leading space is supported")
        self.bytes_of = [bytes([int(pieces[i][3:5], 16)]) if i in set(self.byte_ids.values()) else b"" if i in special else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.decimal = [str(i) for i in range(n)]
        # Symbols are piece ids; a character that isn't a piece is n + its code point.
        score = {p: sp.get_score(i) for p, i in self.ids.items()}
        rank = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        table = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                left, right = p[:k], p[k:]
                if (len(left) == 1 or left in self.ids) and (len(right) == 1 or right in self.ids):
                    table[self.symbol(left), self.symbol(right)] = (rank[score[p]], i)
        self.table = table
        self.wide = n + 0x110000
        order = sorted(table, key=lambda x: x[0] * self.wide + x[1])
        self.keys = np.array([a * self.wide + b for a, b in order] + [1 << 62], dtype=np.int64)
        self.ranks = np.array([table[x][0] for x in order] + [self.NONE], dtype=np.int32)
        self.merged = np.array([table[x][1] for x in order] + [0], dtype=np.int32)
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[32] = self.of_char[ord(SPACE)]

    NONE = 1 << 30

    def symbol(self, piece: str) -> int:
        return self.ids.get(piece, self.size + ord(piece) if len(piece) == 1 else -1)

    def spelled(self, symbols: list[int]) -> list[int]:
        """Ids, with characters that aren't pieces as bytes."""
        if max(symbols, default=0) < self.size:
            return symbols
        return [x for s in symbols for x in ([s] if s < self.size else [self.byte_ids[b] for b in chr(s - self.size).encode("utf-8", "replace")])]

    def encode_word(self, word: str) -> list[int]:
        """The agenda as a heap of (rank, left place): its first pair merges, and its neighbours make new pairs."""
        sym = [int(self.of_char[ord(c)]) for c in word]
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        agenda: list[tuple[int, int, int, int, int]] = []

        def propose(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j < n and (hit := self.table.get((sym[i], sym[j]))):
                heapq.heappush(agenda, (hit[0], i, j, sym[i], sym[j]))

        for i in range(n - 1):
            propose(i)
        while agenda:
            _, i, j, a, b = heapq.heappop(agenda)
            if not (alive[i] and alive[j] and sym[i] == a and sym[j] == b and after[i] == j):
                continue
            sym[i], alive[j], after[i] = self.table[a, b][1], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            propose(before[i])
            propose(i)
        return self.spelled([s for s, x in zip(sym, alive, strict=True) if x])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.wide + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], self.NONE), np.where(hit, self.merged[at], 0)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Row i of a matrix is a word's symbols, and of another the agenda of its adjacent pairs; all words of one
        length take a step together and then join those that were one symbol shorter."""
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.encode_word(w)
            elif w:
                by_length.setdefault(len(w), []).append(i)
        carried = None
        for length in range(max(by_length, default=0), 0, -1):
            own = by_length.get(length, [])
            text = "".join(words[i] for i in own)
            sym = self.of_char[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)].reshape(len(own), length)
            rank, new = self.look_up(sym[:, :-1], sym[:, 1:])
            who = np.array(own, dtype=np.int64)
            if carried is not None:
                who, sym, rank, new = (np.concatenate(x) for x in zip((who, sym, rank, new), carried, strict=True))
            carried = None
            if length > 1:
                at = rank.argmin(axis=1) if len(who) else np.zeros(0, dtype=np.int64)
                rows = np.arange(len(who))
                done = rank[rows, at] == self.NONE
            else:
                done = np.ones(len(who), dtype=bool)
            for i, row in zip(who[done].tolist(), sym[done].tolist(), strict=True):
                out[i] = self.spelled(row)
            if done.all():
                continue
            go = ~done
            who, sym, rank, new, at = who[go], sym[go], rank[go], new[go], at[go]
            rows = np.arange(len(who))
            sym[rows, at] = new[rows, at]
            keep = np.ones(sym.shape, dtype=bool)
            keep[rows, at + 1] = False
            sym = sym[keep].reshape(len(who), length - 1)
            keep = np.ones(rank.shape, dtype=bool)
            keep[rows, at] = False
            rank, new = rank[keep].reshape(len(who), length - 2), new[keep].reshape(len(who), length - 2)
            for side, ok in ((at - 1, at > 0), (at, at < length - 2)):  # the new symbol's left and right pairs
                r, p = rows[ok], side[ok]
                rank[r, p], new[r, p] = self.look_up(sym[r, p], sym[r, p + 1])
            carried = who, sym, rank, new
        return out

    def decode_word(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_words(parts(text)) for i in ids]

    def decode(self, ids: list[int]) -> str:
        text = self.decode_word(ids)
        return text[1:] if text[:1] == " " else text


def parts(text: str | None) -> list[str]:
    return PART.findall(" " + text.replace(SPACE, " ")) if text else []


class Known:
    """The parts that a worker has met: their ids as text; and what they decode to, if not to themselves."""

    def __init__(self, model: Merges, check: bool):
        self.model, self.check = model, check
        self.ids: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}

    def learn(self, found: set[str]) -> None:
        """Afterwards ids has all that is found. What wasn't met since ids was last full is forgotten."""
        if len(self.ids) > REMEMBERED:
            self.ids, self.older = {}, self.ids
            if len(self.odd) > REMEMBERED:
                self.odd, self.older = {}, {}
        missing = found - self.ids.keys()
        again = missing & self.older.keys()
        self.ids.update((w, self.older[w]) for w in again)
        new = list(missing - again)
        m, decimal = self.model, self.model.decimal
        for start in range(0, len(new), 50_000):
            words = new[start : start + 50_000]
            coded = m.encode_words(words)
            if self.check:
                self.compare(words, coded)
            for w, ids in zip(words, coded, strict=True):
                self.ids[w] = ",".join([decimal[i] for i in ids])
                if (back := m.decode_word(ids)) != w:
                    self.odd[w] = back

    def compare(self, words: list[str], coded: list[list[int]]) -> None:
        """Against the library, which puts a space before a text."""
        mine = [(w, ids) for w, ids in zip(words, coded, strict=True) if w[0] == " " and len(w) > 1]
        theirs = self.model.sp.encode([w[1:] for w, _ in mine], num_threads=1)
        for (w, ids), other in zip(mine, theirs, strict=True):
            if ids != other:
                raise ValueError(f"{w!r} is {ids} here and {other} in the library")


def load(path: str, proto: bytes) -> Merges:
    if path not in _models:
        _models[path] = Merges(proto=proto)
    return _models[path]


_known: dict[tuple[str, bool], Known] = {}


def encode_decode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), check: bool = True, digest: bool = False
) -> DataFrame:
    """One row per document: id, `keep` columns, n_tokens, ids (decimal, comma-joined), decoded.

    Ids are those of the sentencepiece library without begin and end ids and without sampling; decoded is its
    decode(ids). Of pairs with equal scores the leftmost merges first, as there. A null or empty text has no ids. An empty table gives
    no rows. Repeated rows are coded again; nothing is shuffled. A text of any length is coded part by part. Other columns aren't read; a kept
    one that is named like a result gets _in appended.

    With `check` the parts of the words that a worker meets for the first time are coded by the library as well, and so
    is, as a whole, every WHOLE-th text of a batch; a difference is an error. With `digest` ids and decoded are their
    SHA-256 instead, so that long results needn't leave the worker. A worker remembers at most twice REMEMBERED parts and
    those of a batch. The model file is read by the driver and sent to the executors, half a megabyte."""
    proto = open(model_path, "rb").read()  # noqa: SIM115
    cast = docs.sparkSession.sparkContext.broadcast(proto)

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode("utf-8", "replace")).hexdigest()

    def work(texts):
        model = load(model_path, cast.value)
        known = _known.setdefault((model_path, check), Known(model, check))
        split = [parts(t) for t in texts]
        known.learn(set().union(*split))
        get, odd, counts, coded, plain = known.ids.__getitem__, known.odd, [], [], []
        for i, p in enumerate(split):
            ids = ",".join(map(get, p))
            text = "".join([odd.get(x, x) for x in p] if odd else p)[1:]
            if check and i % WHOLE == 0 and p:
                theirs = model.sp.encode(texts[i], num_threads=1)
                if ids != ",".join(map(str, theirs)) or text != model.sp.decode(theirs):
                    raise ValueError(f"{texts[i][:200]!r} is coded in another way by the library")
            counts.append(ids.count(",") + 1 if ids else 0)
            coded.append(sha(ids) if digest else ids)
            plain.append(sha(text) if digest else text)
        return [pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())]

    return per_text(docs, work, SCHEMA, id_col, text_col, keep)
