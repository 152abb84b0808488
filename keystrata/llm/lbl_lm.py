"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation, and exact unigram counts.

The model predicts a word from the two before it: score(w | u, v) = (A1[v] + A2[u]) . R[w] + b[w]. Because the two contexts
add up, the normaliser of all pairs of contexts is one matrix product, Z = exp(A1 R' + b) exp(A2 R')', so that every token
gets a normalised probability. The most frequent words are symbols of their own; every other word, seen or not, belongs to
one of the classes told by a word's last bytes, whose number grows with the distinct training words. Words of a class share
its probability in the ratio of their training counts plus one; those counts are exact, over all training documents."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keystrata.llm.common import LOWER_BYTES, carry, cut, evened, map_arrow, named, names_beside, numbered, slices

#: Words with a row of their own, with the end and the first class, at least; and numbers in a row.
VOCABULARY, WIDTH = 2048, 24
#: Those words are this many times the cube root of the distinct training words, where that is more.
NAMED = 12
#: Classes of all other words: this many times the cube root of the distinct training words. The normalisers, a number for
#: every two symbols, then grow by less than the words do.
CLASSES = 4
#: Bytes at a word's end that tell its class.
ENDING = 3
#: Noise words that every position of a step is told from, and positions of a step.
NOISE, STEP = 32, 512
RATE = 0.4
#: Training documents are dealt to shards of about so many tokens, by a hash, and to rounds. In each round all shards train from
#: one model, alone, on their documents of the round, and their models are averaged.
SHARD_TOKENS, ROUNDS = 1 << 20, 2
#: Words whose counts are broadcast, at most; the counts of all others are joined.
FREQUENT = 150_000
#: Distinct words that a task adds up before it lets them go.
HELD = 400_000
#: Models that one task averages.
FAN_IN = 64
#: The first class and the end. Further classes come after the words.
CLASS_ID, END_ID = 0, 1
#: Tokens scored, and rows of normalisers made, at once; and text of which the tokens are held.
PIECE, ROWS = 1 << 16, 256
SCORED_BYTES = 2 << 20
#: The end of a text as a token: no word, since words have no white space.
END = b"\n"


def tokens_of(text: str | None) -> list[bytes]:
    return [*text.encode("utf-8", "replace").translate(LOWER_BYTES).split(), END] if text else [END]


def class_count(n_types: int) -> int:
    return max(1, round(CLASSES * n_types ** (1 / 3)))


class Symbols(dict):
    """The symbol of every word: its own, or that of its class, which isn't kept."""

    def __init__(self, words: list[bytes], classes: int):
        super().__init__((w, i) for i, w in enumerate(words) if i != CLASS_ID)
        self.named, self.classes = len(words), classes

    def __reduce__(self):
        words = [b"", *sorted(self, key=self.get)]
        return Symbols, (words, self.classes)

    def __missing__(self, word: bytes) -> int:
        k = zlib.crc32(word[-ENDING:]) % self.classes
        return self.named + k - 1 if k else CLASS_ID

    def __len__(self) -> int:
        return self.named + self.classes - 1

    def is_class(self) -> np.ndarray:
        out = np.arange(len(self)) >= self.named
        out[CLASS_ID] = True
        return out


def class_totals(counts: DataFrame, symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct words of every symbol but the end. The driver gets a row a symbol."""
    n, v = np.zeros(len(symbols)), np.zeros(len(symbols))

    def work(batches):
        for b in batches:
            ids = [symbols[w] for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b.column("c")], names=["symbol", "c"])

    rest = counts.select("word", "c").filter(F.col("word") != F.lit(END))
    for r in map_arrow(rest, work, "symbol long, c long").groupBy("symbol").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r["symbol"]], v[r["symbol"]] = r["n"], r["v"]
    return n, v


def word_counts(training: DataFrame) -> DataFrame:
    """word, c over all rows of `text`. Tasks add up before they shuffle."""

    def work(batches):
        counts: dict[bytes, int] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
            counts.clear()
            return out

        for b in batches:
            for text in b.column("text").to_pylist():
                get = counts.get
                for w in tokens_of(text):
                    counts[w] = get(w, 0) + 1
                if len(counts) > HELD:
                    yield rows()
        if counts:
            yield rows()

    return map_arrow(training.select("text"), work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> list[tuple[bytes, int]]:
    """The words of the highest counts, at most `most`: all from the least count bucket (a sixteenth of an octave) that
    fits. The driver gets a row for each bucket and then these words, the most frequent first."""
    bucket = F.floor(F.log2("c") * 16)
    sizes = sorted(counts.groupBy(bucket.alias("k")).count().collect(), key=lambda r: -r["k"])
    least, total = None, 0
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["k"]
    if least is None:
        return []
    rows = counts.filter(bucket >= least).collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


@dataclass
class Model:
    a1: np.ndarray
    a2: np.ndarray
    r: np.ndarray
    b: np.ndarray

    @staticmethod
    def start(unigram: np.ndarray, width: int = WIDTH) -> Model:
        rng = np.random.default_rng(7)
        near = [rng.normal(0, 0.1, (len(unigram), width)).astype(np.float32) for _ in range(3)]
        return Model(*near, np.log(unigram).astype(np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.a1, self.a2, self.r, self.b]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """first[v, w], second[u, w] and log Z[v, u]."""
        first, second = self.a1 @ self.r.T + self.b, self.a2 @ self.r.T
        m1, m2 = first.max(axis=1), second.max(axis=1)
        z = np.exp(first - m1[:, None]) @ np.exp(second - m2[:, None]).T
        return first, second, np.log(z) + m1[:, None] + m2[None, :]

    def log_z(self) -> np.ndarray:
        """The normalisers of `tables`, log Z[v, u], with one more table than the result in memory."""
        second = self.a2 @ self.r.T
        m2 = second.max(axis=1)
        np.exp(np.subtract(second, m2[:, None], out=second), out=second)
        out = np.empty((len(self.b), len(self.b)), dtype=np.float32)
        for i in range(0, len(self.b), ROWS):
            first = self.a1[i : i + ROWS] @ self.r.T + self.b
            m1 = first.max(axis=1)
            out[i : i + ROWS] = np.log(np.exp(first - m1[:, None]) @ second.T) + m1[:, None] + m2[None, :]
        return out

    def scores(self, w: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Not normalised; of words after pairs of contexts."""
        out = np.empty(len(w), dtype=np.float32)
        for i in range(0, len(w), PIECE):
            at = slice(i, i + PIECE)
            out[at] = np.einsum("ij,ij->i", self.a1[v[at]] + self.a2[u[at]], self.r[w[at]]) + self.b[w[at]]
        return out


class Trainer:
    """Steps of noise-contrastive estimation with Adagrad. Every position of a step is told from the same noise words."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int):
        self.m = Model(*[a.copy() for a in model.arrays()])
        self.sums = [np.full(a.shape, 1e-2, dtype=np.float32) for a in self.m.arrays()]
        self.noise, self.log_kn = np.cumsum(noise), (np.log(noise) + np.log(NOISE)).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.seen = 0

    def update(self, k: int, ids: np.ndarray, grad: np.ndarray) -> None:
        ids = ids.astype(np.uint16) if len(self.noise) < 1 << 16 else ids  # sorted by digits then
        order = np.argsort(ids, kind="stable")
        s = ids[order]
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        rows, total = s[starts], np.add.reduceat(grad[order], starts, axis=0)
        acc = self.sums[k][rows]
        acc += total * total
        self.sums[k][rows] = acc
        total *= np.float32(RATE)
        total /= np.sqrt(acc, out=acc)
        self.m.arrays()[k][rows] += total

    def step(self, w: np.ndarray, v: np.ndarray, u: np.ndarray) -> None:
        m = self.m
        x = np.minimum(np.searchsorted(self.noise, self.rng.random(NOISE)), len(self.noise) - 1)
        h = m.a1[v] + m.a2[u]
        rw, rx = m.r[w], m.r[x]
        data = np.einsum("ij,ij->i", h, rw) + (m.b[w] - self.log_kn[w])
        noise = h @ rx.T
        noise += m.b[x] - self.log_kn[x]
        for z in (data, noise):
            np.clip(z, -30, 30, out=z)
        np.exp(data, out=data)
        data += 1
        np.reciprocal(data, out=data)
        np.negative(noise, out=noise)
        np.exp(noise, out=noise)
        noise += 1
        np.divide(np.float32(-1), noise, out=noise)
        scale = np.float32(1 / len(w))
        data *= scale
        noise *= scale
        dh = noise @ rx
        dh += data[:, None] * rw
        both = np.concatenate((w, x))
        self.update(2, both, np.concatenate((data[:, None] * h, noise.T @ h)))
        self.update(3, both, np.concatenate((data, noise.sum(axis=0))))
        self.update(0, v, dh)
        self.update(1, u, dh)
        self.seen += len(w)


def contexts(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each and the one before that; texts begin at starts, with the end as what was before."""
    v, u = np.empty_like(ids), np.empty_like(ids)
    v[1:], u[2:] = ids[:-1], ids[:-2]
    v[starts] = END_ID
    u[starts] = END_ID
    second = starts + 1
    u[second[second < len(ids)]] = END_ID  # where a text has one token, that place is the next text's first
    return v, u


def sharded(training: DataFrame, symbols: Symbols, shards: int, rounds: int, key: list[str]) -> DataFrame:
    """shard, round, k, ids: the symbols of every row of `text`, in an order that follows from the rows alone. Written to the
    checkpoint folder."""
    cast = training.sparkSession.sparkContext.broadcast(symbols)
    kind = np.uint16 if len(symbols) < 1 << 16 else np.uint32

    def work(batches):
        ids_of = cast.value
        for b in batches:
            ids = [np.fromiter(map(ids_of.__getitem__, tokens_of(x)), dtype=kind).tobytes() for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("round"), b.column("k"), pa.array(ids, pa.binary())], names=["shard", "round", "k", "ids"])

    k = F.xxhash64(*key)
    given = training.select(F.pmod(k, F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64(k), F.lit(rounds)).cast("int").alias("round"), k.alias("k"), "text")
    return cut(map_arrow(given, work, "shard int, round int, k long, ids binary").repartition(shards, "shard").sortWithinPartitions("shard", "k"))


def trained(batches: Iterator[pa.RecordBatch], start: Model, noise: np.ndarray, seed: int) -> Iterator[tuple[int, Trainer]]:
    """Every shard of a task, with what it makes of the model."""
    kind = np.uint16 if len(noise) < 1 << 16 else np.uint32
    shard, t = None, None
    rest = [np.zeros(0, dtype=np.int64)] * 3

    def feed(w: np.ndarray, v: np.ndarray, u: np.ndarray, last: bool = False) -> None:
        nonlocal rest
        w, v, u = (np.concatenate(x) for x in zip(rest, (w, v, u), strict=True))
        n = len(w) if last else len(w) // STEP * STEP
        for i in range(0, n, STEP):
            t.step(w[i : i + STEP], v[i : i + STEP], u[i : i + STEP])
        rest = [w[n:], v[n:], u[n:]]

    nothing = [np.zeros(0, dtype=np.int64)] * 3
    for b in batches:
        of = b.column("shard").to_numpy()
        lists = [np.frombuffer(x, dtype=kind) for x in b.column("ids").to_pylist()]
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            if of[x] != shard:
                if t is not None:
                    feed(*nothing, last=True)
                    yield shard, t
                shard, t = int(of[x]), Trainer(start, noise, 1000 * seed + int(of[x]))
            sizes = np.array([len(i) for i in lists[x:y]], dtype=np.int64)
            ids = np.concatenate(lists[x:y]).astype(np.int64)
            feed(ids, *contexts(ids, np.cumsum(sizes) - sizes))
    if t is not None:
        feed(*nothing, last=True)
        yield shard, t


#: A model travels in so many parts, which are added up apart from each other.
PARTS = 16
_MODELS = "part long, block int, weight double, data binary"


def _added(table: pa.Table) -> pa.Table:
    """One part of several models, added up in the order of the models."""
    order = np.argsort(table.column("part").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    data = sum(np.frombuffer(x, dtype=np.float32).astype(np.float64) for x in table.column("data").to_pylist())
    part, block, weight = table.column("part")[0].as_py(), table.column("block")[0].as_py(), sum(table.column("weight").to_pylist())
    return pa.table({"part": pa.array([part // FAN_IN], pa.int64()), "block": pa.array([block], pa.int32()), "weight": pa.array([weight], pa.float64()), "data": pa.array([data.astype(np.float32).tobytes()], pa.binary())})


def train(training: DataFrame, symbols: Symbols, unigram: np.ndarray, n_tokens: int, key: list[str], rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS) -> Model:
    """One pass over all rows of `text`, in rounds. In a round every shard trains from the same model; the results are averaged with their
    numbers of tokens as weights, FAN_IN at a time, so that no task or driver holds many of them. Shards, their order and
    their random numbers follow from the rows' key columns, not from where the rows are read."""
    sc = training.sparkSession.sparkContext
    shards = max(1, -(-n_tokens // shard_tokens))
    coded = sharded(training, symbols, shards, rounds, key)
    model = Model.start(unigram)
    for r in range(rounds):
        cast = sc.broadcast((model.arrays(), unigram, r))

        def work(batches, cast=cast):
            arrays, noise, seed = cast.value
            for shard, t in trained(batches, Model(*arrays), noise, seed):
                flat = np.concatenate([a.ravel() for a in t.m.arrays()]).astype(np.float32) * np.float32(t.seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * PARTS, pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array([float(t.seen)] * PARTS, pa.float64()), pa.array([p.tobytes() for p in np.array_split(flat, PARTS)], pa.binary())],
                    names=["part", "block", "weight", "data"],
                )

        models, parts = map_arrow(coded.filter(F.col("round") == r).select("shard", "ids"), work, _MODELS), shards
        while True:
            models = models.groupBy((F.col("part") / FAN_IN).cast("long").alias("_g"), "block").applyInArrow(lambda t: _added(t), _MODELS)
            parts = -(-parts // FAN_IN)
            if parts <= 1:
                break
        rows = sorted(models.collect(), key=lambda x: x["block"])
        if not rows:
            continue
        flat = np.concatenate([np.frombuffer(x["data"], dtype=np.float32) / x["weight"] for x in rows]).astype(np.float32)
        out, at = [], 0
        for a in model.arrays():
            out.append(flat[at : at + a.size].reshape(a.shape))
            at += a.size
        model = Model(*out)
    return model


_tables: dict[str, tuple] = {}


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), vocabulary: int = VOCABULARY, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, `keep` columns, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words without ASCII white space, with A-Z lower-cased, then one end. base_score is the sum over tokens of
    log10((c + 1) / (N + V + 1)), with the token's count c, all N and the distinct V training tokens; n_known counts tokens
    with c > 0; score is the model's log10 probability of the text. A null or empty text is one end, in training too. With
    no training rows N and V are 0 and score is base_score. An empty table of documents gives no rows. Of words with equal
    counts the one that sorts first gets a row of its own. Repeated ids and rows stay, told apart as `numbered` does;
    null ids too. Texts count whole, scored in pieces where they are long. Other columns aren't read; a kept one that is named like a result gets _in appended.
    Scores don't depend on how the rows are dealt to tasks, but for the order in which they are added up.

    Counts of at most `frequent` words go to the executors; all others are joined by word, which none of them can skew."""
    key = [c for c in (id_col,) if c in training.columns]
    training = training.select(*(named(c).alias(f"k{i}") for i, c in enumerate(key)), named(text_col).alias("text"))
    key = training.columns
    training = evened(training)
    counts = cut(word_counts(training))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head = frequent_words(counts, frequent)
    rows_of_own = max(vocabulary, round(NAMED * v ** (1 / 3)))
    words = [b"", END, *[w for w, _ in head if w != END][: rows_of_own - 2]]
    have = dict(head)
    symbols = Symbols(words, class_count(v))
    tokens, types = class_totals(counts, symbols)
    # Of a class, all that its words share: their tokens and one for each, and one for what was never seen.
    log_shared = np.where(symbols.is_class(), np.log10(tokens + types + 1), 0.0)
    tokens[END_ID] = have.get(END, 0)
    unigram = (tokens + 1) / (tokens + 1).sum()
    model = train(training, symbols, unigram, n, key, rounds) if n else Model.start(unigram)
    order = [(w, c, symbols[w]) for w, c in head]
    log_base = float(np.log10(n + v + 1))
    cast = docs.sparkSession.sparkContext.broadcast((model.arrays(), model.log_z(), order, symbols, log_shared))

    carried = [id_col, *(c for c in dict.fromkeys(keep) if c != id_col)]
    given, fields = carry(docs, text_col, carried)
    given = evened(numbered(given, "_k0", "_text")).select("_text", "rid", "rk", *(f.name for f in fields))

    def load():
        if run not in _tables:
            arrays, z, rows, symbols, log_shared = cast.value
            _tables.clear()
            known = {w: i for i, (w, _, _) in enumerate(rows)}
            log_c = np.log10(np.array([c + 1 for _, c, _ in rows] + [1.0]))
            _tables[run] = known, log_c, np.array([i for _, _, i in rows] + [CLASS_ID], dtype=np.int64), Model(*arrays), z, symbols, log_shared
        return _tables[run]

    run = uuid.uuid4().hex
    nothing = np.zeros(0, dtype=np.int64)

    def work(batches):
        known, log_c, model_id, model, z, symbols, log_shared = load()
        is_class = symbols.is_class()
        get, none = known.get, len(known)
        end_known = END in known
        for b in (part for whole in batches for part in slices(whole, SCORED_BYTES, "_text")):
            texts, rid, rk = b.column("_text").to_pylist(), b.column("rid").to_numpy(), b.column("rk").to_numpy()
            lists = [tokens_of(t) for t in texts]
            sizes = np.array([len(x) for x in lists], dtype=np.int64)
            starts = np.cumsum(sizes) - sizes
            flat = [w for x in lists for w in x]
            at = np.fromiter((get(w, none) for w in flat), dtype=np.int64, count=len(flat)) if flat else nothing
            ids = model_id[at]
            is_known = at < none
            rare = np.flatnonzero(~is_known)
            ids[rare] = np.fromiter((symbols[flat[i]] for i in rare.tolist()), dtype=np.int64, count=len(rare))
            if not end_known:
                ids[starts + sizes - 1] = END_ID
            last, before = contexts(ids, starts)
            logs = (model.scores(ids, last, before) - z[last, before]) / np.log(10) - log_shared[ids]
            shared = is_class[ids] & is_known
            add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
            doc_of = np.searchsorted(starts, rare, side="right") - 1
            tallies: dict[tuple[int, bytes], int] = {}
            for d, i in zip(doc_of.tolist(), rare.tolist(), strict=True):
                k = d, flat[i]
                tallies[k] = tallies.get(k, 0) + 1
            r_doc = np.fromiter((d for d, _ in tallies), dtype=np.int64, count=len(tallies))
            k, m = len(texts), len(tallies)
            own = [pa.concat_arrays([b.column(i), pa.nulls(m, b.column(i).type)]) for i in range(3, b.num_columns)]
            # A document's own row joins with nothing: its word has spaces.
            word = pa.array([b" %d %d" % x for x in zip(rid.tolist(), rk.tolist(), strict=True)] + [w for _, w in tallies], pa.binary())
            end_rare = np.array([0] * k + [w == END for _, w in tallies], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((rid, rid[r_doc]))),
                    pa.array(np.concatenate((rk, rk[r_doc]))),
                    word,
                    pa.array([0] * k + list(tallies.values()), pa.int64()),
                    pa.array(end_rare),
                    pa.array(np.concatenate((sizes, np.zeros(m, dtype=np.int64)))),
                    pa.array(np.concatenate((add(is_known.astype(np.int64)), np.zeros(m, dtype=np.int64)))),
                    pa.array(np.concatenate((add(log_c[at]), np.zeros(m)))),
                    pa.array(np.concatenate((add(logs + np.where(shared, log_c[at], 0.0)), np.zeros(m)))),
                    *own,
                ],
                names=["rid", "rk", "_word", "_tf", "_end", "_n", "_known", "_log_c", "_model", *(f.name for f in fields)],
            )

    made = StructType.fromDDL("rid long, rk int, _word binary, _tf long, _end boolean, _n long, _known long, _log_c double, _model double")
    parts = map_arrow(given, work, StructType([*made.fields, *fields]))
    joined = parts.join(counts.select(F.col("word").alias("_word"), "c"), "_word", "left")
    log_tf = F.col("_tf") * F.log10(F.coalesce("c", F.lit(0)) + 1)
    sums = joined.groupBy("rid", "rk").agg(
        F.sum("_n").alias("n_tokens"),
        F.sum(F.col("_known") + F.when(F.col("c") > 0, F.col("_tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("_log_c") + log_tf).alias("_log_c"),
        F.sum(F.col("_model") + F.when(F.col("_end"), 0.0).otherwise(log_tf)).alias("_model"),
        *(F.max_by(F.col(f.name), F.col("_n")).alias(f.name) for f in fields),
    )
    base = F.col("_log_c") - F.col("n_tokens") * log_base
    model_score = F.col("_model") if n else base
    own = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    ids = (F.col(f.name).alias(x) for f, x in zip(fields, names_beside(carried, own), strict=True))
    return sums.select(*ids, "n_tokens", "n_known", F.lit(int(n)).alias("train_tokens"), base.alias("base_score"), model_score.alias("score"))
