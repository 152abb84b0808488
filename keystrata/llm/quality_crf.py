"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.common import named, per_text

#: Labelled documents that the field is fitted on, those of the least hashes; and the bytes of their texts.
MAX_LABELLED, MAX_LABELLED_BYTES = 1500, 64 << 20
#: Lines of a chain in the fit; a longer document is several chains.
CHAIN = 200
#: A document is kept if at least this share of its words' characters stands in content lines.
CONTENT_SHARE = 0.5
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, content_share double, n_lines long, n_content_lines long, content_lines array<int>"
)

_ODD = re.compile(r"[^\w\s.,;:!?'\"()\-]|_")
_LETTER = re.compile(r"[^\W\d_]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LINK = re.compile(r"https?:|www\.|\S@\S|©|\(c\)", re.IGNORECASE)
_NOTICE = re.compile(r"\b(?:cookies?|copyright|all rights reserved|privacy|terms of (?:use|service)|subscribe|sign up|log ?in|click here|javascript|licen[sc]ed?)\b", re.IGNORECASE)

#: Cut points of the measures below; each makes an indicator for every interval.
CUTS = {
    "words": (2, 4, 8, 16, 40),
    "odd": (0.002, 0.02, 0.06, 0.12, 0.3),
    "upper": (0.05, 0.15, 0.3, 0.6, 0.9),
    "digits": (0.01, 0.05, 0.15, 0.4),
    "exclaims": (0.001, 0.02, 0.06),
    "distinct": (0.3, 0.5, 0.7, 0.9),
    "word_length": (2.5, 4.0, 6.0, 9.0),
    "stops": (0.01, 0.04, 0.1),
    "odd_words": (0.02, 0.1, 0.25, 0.5),
}
FLAGS = ("closed", "again", "link", "notice", "opens_lower")
N_FEATURES = 1 + sum(len(c) + 1 for c in CUTS.values()) + len(FLAGS)
_EDGES = {k: np.array(v) for k, v in CUTS.items()}


def measures(line: str, again: bool) -> tuple:
    """Of a line with a word."""
    words = line.split()
    n, chars = len(words), len(line)
    odd = len(_ODD.findall(line))
    letters = len(_LETTER.findall(line))
    last = line.rstrip()[-1:]
    return (
        n,
        odd / chars,
        len(_UPPER.findall(line)) / max(1, letters),
        sum(map(str.isdigit, line)) / chars if any(d in line for d in "0123456789") else 0.0,
        line.count("!") / chars,
        len(set(words)) / n,
        sum(map(len, words)) / n,
        (line.count(". ") + line.count(", ") + (last in ".!?")) / n,
        sum(1 for w in words if _ODD.search(w)) / n if odd else 0.0,
        last in ".!?:\"'",
        again,
        bool(_LINK.search(line)),
        bool(_NOTICE.search(line)),
        line.lstrip()[:1].islower(),
    )


def features(rows: list[tuple]) -> np.ndarray:
    out = np.zeros((len(rows), N_FEATURES), dtype=np.float32)
    if not rows:
        return out
    m = np.array(rows, dtype=np.float64)
    out[:, 0] = 1
    at, every = 1, np.arange(len(rows))
    for k, edges in enumerate(_EDGES.values()):
        out[every, at + np.searchsorted(edges, m[:, k], side="right")] = 1
        at += len(edges) + 1
    out[:, at:] = m[:, len(CUTS) :]
    return out


def lines_of(text: str | None) -> tuple[list[int], list[tuple]]:
    """Places of the lines with a word among all lines, and their measures."""
    places, rows, seen = [], [], set()
    for i, line in enumerate(text.split("\n") if text else ()):
        if line.strip():
            places.append(i)
            rows.append(measures(line, line in seen))
            seen.add(line)
    return places, rows


class Field:
    """Two labels: 0 boilerplate, 1 content. score(y) = sum emit[t, y_t] + sum move[y_t, y_t+1] + first[y_0]."""

    def __init__(self, weights: np.ndarray | None = None, move: np.ndarray | None = None, first: np.ndarray | None = None):
        self.weights = np.zeros((N_FEATURES, 2)) if weights is None else weights
        self.move = np.zeros((2, 2)) if move is None else move
        self.first = np.zeros(2) if first is None else first

    def gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood and its gradients over padded sequences, by the forward and backward recursions."""
        n, t, _ = x.shape
        emit = (x @ self.weights.astype(x.dtype)).astype(np.float64)
        a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        a[:, 0] = emit[:, 0] + self.first
        for i in range(1, t):
            step = np.logaddexp.reduce(a[:, i - 1, :, None] + self.move, axis=1) + emit[:, i]
            a[:, i] = np.where(mask[:, i, None], step, a[:, i - 1])
        for i in range(t - 2, -1, -1):
            step = np.logaddexp.reduce(self.move + (emit[:, i + 1] + b[:, i + 1])[:, None, :], axis=2)
            b[:, i] = np.where(mask[:, i + 1, None], step, 0)
        z = np.logaddexp.reduce(a[:, -1], axis=1)
        node = np.exp(a + b - z[:, None, None]) * mask[..., None]
        true = np.eye(2)[y] * mask[..., None]
        diff = true - node
        pair_mask = mask[:, 1:, None, None]
        pair = np.exp(a[:, :-1, :, None] + self.move + (emit[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair_mask
        seen = true[:, :-1, :, None] * true[:, 1:, None, :] * pair_mask
        g_move = (seen - pair).sum(axis=(0, 1))
        value = (emit * true).sum() + (seen * self.move).sum() + (true[:, 0] * self.first).sum() - z.sum()
        return value, x.reshape(n * t, -1).T @ diff.reshape(n * t, 2).astype(x.dtype), g_move, diff[:, 0].sum(axis=0)

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = 40, rate: float = 0.2, decay: float = 1e-3) -> Field:
        """Adam on the penalised log-likelihood; sequences of like length are padded together."""
        groups = []
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        at = 0
        while at < len(order):
            size = max(1, 20_000 // max(1, len(sequences[order[min(at + 50, len(order) - 1)]])))
            part = order[at : at + size]
            at += size
            t = len(sequences[part[-1]])
            x, y, mask = np.zeros((len(part), t, N_FEATURES), dtype=np.float32), np.zeros((len(part), t), dtype=np.int64), np.zeros((len(part), t), dtype=bool)
            for r, i in enumerate(part):
                k = len(sequences[i])
                x[r, :k], y[r, :k], mask[r, :k] = sequences[i], labels[i], True
            groups.append((x, y, mask))
        params = [self.weights, self.move, self.first]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        total = sum(len(s) for s in sequences)
        for step in range(1, steps + 1):
            grads = [np.zeros_like(p) for p in params]
            for x, y, mask in groups:
                _, *g = self.gradient(x, y, mask)
                for k in range(3):
                    grads[k] += g[k]
            for k, p in enumerate(params):
                g = grads[k] / total - decay * p
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p += rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self

    def viterbi(self, emit: list[list[float]]) -> list[int]:
        """The best labels of one sequence of emission scores."""
        if not emit:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        s0, s1 = emit[0][0] + self.first[0], emit[0][1] + self.first[1]
        back = []
        for e0, e1 in emit[1:]:
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((0 if a >= b else 1, 0 if c > d else 1))
            s0, s1 = (a if a >= b else b) + e0, (c if c > d else d) + e1
        y = [0 if s0 > s1 else 1]
        for step in reversed(back):
            y.append(step[y[-1]])
        return y[::-1]


def fit_lines(labelled: list[tuple[str, int]]) -> Field:
    """Lines have no labels, documents do. Every line starts with its document's; then lines of bad documents that the
    field itself calls content lose theirs, and it is fitted again. Without both kinds of documents all weights stay 0,
    and every line is content."""
    data = [(features(rows[i : i + CHAIN]), q) for text, q in labelled if (rows := lines_of(text)[1]) for i in range(0, len(rows), CHAIN)]
    if len({q for _, q in data}) < 2:
        return Field()
    xs = [x for x, _ in data]
    ys = [np.full(len(x), int(q > 0), dtype=np.int64) for x, q in data]
    field = Field().fit(xs, ys)
    for i, (x, q) in enumerate(data):
        if q == 0:
            lean = x @ (field.weights[:, 1] - field.weights[:, 0])
            again = (lean > 0).astype(np.int64)
            ys[i] = again if again.mean() < 1 else ys[i]
    return Field().fit(xs, ys)


def base_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; words are runs without ASCII white space."""
    if not text:
        return 0, 0, 0, 0, 0
    w = text.encode("utf-8", "replace").split()
    n = len(w)
    spaces = sum(text.count(c) for c in " \t\n\v\f\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n > 3:
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) < len(windows):
            count = Counter(windows)
            until = 0
            for i, x in enumerate(windows):
                if count[x] > 1:
                    repeat += i + 3 - max(until, i)
                    until = i + 3
    return n, len(text) - spaces, symbols, dup, repeat


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, most_bytes: int = MAX_LABELLED_BYTES) -> list[tuple[str, int]]:
    """Text and label of at most `most` labelled documents, those of the least hashes; whole documents as long as their
    bytes add up to no more than `most_bytes`. Rows that repeat an id and text count once."""
    known = labels.select(named(id_col).alias("i"), named(label_col).alias("q")).filter("i is not null and q is not null").groupBy("i").agg(F.min("q").alias("q"))
    ids = known.orderBy(F.xxhash64("i"), "i").limit(most)
    rows = docs.select(named(id_col).alias("i"), named(text_col).alias("t")).filter("t is not null").join(F.broadcast(ids), "i")
    rows = rows.dropDuplicates(["i", "t"]).orderBy(F.xxhash64("i"), "i", "t").limit(most)
    size = F.sum(F.octet_length("t")).over(Window.orderBy(F.xxhash64("i"), "i", "t"))  # of at most `most` rows
    some = rows.withColumn("_s", size).filter(F.col("_s") <= most_bytes)
    return [(r["t"], int(r["q"])) for r in sorted(some.select("i", "t", "q").collect(), key=lambda r: (r["i"], r["t"]))]


def quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    keep: tuple[str, ...] = (),
    max_labelled: int = MAX_LABELLED,
    content_share: float = CONTENT_SHARE,
    max_labelled_bytes: int = MAX_LABELLED_BYTES,
) -> DataFrame:
    """One row per document: id, `keep` columns, the base measures, base_failed, kept, content_share, n_lines,
    n_content_lines and content_lines (numbers of the lines marked as content, from 0).

    base_failed: fewer than 50 words, or more than half of them in three-word windows that occur twice. kept: not
    base_failed, and at least `content_share` of the words' characters stand in lines that Viterbi decoding marks as
    content; of two equally good labels of a line content is taken. Lines without a word aren't decoded. The field is fitted
    on at most `max_labelled` labelled documents and `max_labelled_bytes` of text, those of the least hashed ids, with all
    their lines; labels or ids that are null don't count, of several labels the worst does. A null or empty text
    has no words and fails. An empty table gives no rows; without labels every line is content. A text of any length is decoded whole. Documents are judged alone where they are read;
    repeated rows stay repeated. Other columns aren't read; a kept one that is named like a result gets _in appended."""
    field = fit_lines(training_sample(docs, labels, id_col, text_col, label_col, max_labelled, max_labelled_bytes))
    packed = (field.weights, field.move, field.first)

    def work(texts):
        model = Field(*packed)
        kinds = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        lines = [lines_of(t) for t in texts]
        emit = (features([r for _, rows in lines for r in rows]) @ model.weights).tolist()
        out, at = [], 0
        for text, (places, rows) in zip(texts, lines, strict=True):
            y = model.viterbi(emit[at : at + len(rows)])
            at += len(rows)
            size = [r[0] * r[6] for r in rows]
            share = sum(s for s, k in zip(size, y, strict=True) if k) / sum(size) if rows else 0.0
            base = base_measures(text)
            failed = base[0] < MIN_WORDS or 100 * base[4] > 50 * base[0]
            content = [p for p, k in zip(places, y, strict=True) if k]
            out.append((*base, failed, not failed and share >= content_share, share, len(rows), len(content), content))
        return [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]

    return per_text(docs, work, SCHEMA, id_col, text_col, keep)
