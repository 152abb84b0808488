"""MinHash near-duplicates: banded candidates, sequential Bayesian pruning, exact verification, components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import LOWER_BYTES, NO_ID, cut, evened, join_hot, keyed, map_arrow, slices
from keystrata.llm.rolling import mix, prefix_sums, range_hashes

WORDS_PER_SHINGLE = 3
THRESHOLD = 85
#: Probability with which a pair at the threshold may share no band, and the signature values that may be spent on that.
NO_BAND, MOST_VALUES = 1 / 80_000, 160
#: Signature values compared before each look at the posterior.
STEP = 24
#: A pair is dropped when its similarity reaches the threshold with less than this posterior probability.
MISS = 1e-6
#: Members of a bucket that meet in one task; and text whose shingles are hashed at once.
BLOCK = 1024
TEXT_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(85)
_ADD = _rng.integers(0, 1 << 32, MOST_VALUES, dtype=np.uint64).astype(np.uint32)
_MUL = (_rng.integers(0, 1 << 31, MOST_VALUES, dtype=np.uint64) * 2 + 1).astype(np.uint32)


@dataclass(frozen=True)
class Plan:
    """Words of a shingle, percents of similarity, and rows and number of bands."""

    width: int
    threshold: int
    rows: int
    bands: int

    @property
    def values(self) -> int:
        return self.rows * self.bands

    @staticmethod
    def of(width: int, threshold: int) -> Plan:
        """The widest bands of which enough, for NO_BAND, are no more than MOST_VALUES: 24 of 6 for 85 percent, 29 of 5 for 80."""
        for rows in range(MOST_VALUES, 0, -1):
            bands = int(np.ceil(np.log(NO_BAND) / np.log1p(-min((threshold / 100) ** rows, 1 - 1e-12))))
            if rows * bands <= MOST_VALUES:
                return Plan(width, threshold, rows, bands)
        raise ValueError(f"{MOST_VALUES} signature values are too few for {threshold} percent")


CONTRACT = Plan.of(WORDS_PER_SHINGLE, THRESHOLD)
ROWS, BANDS = CONTRACT.rows, CONTRACT.bands


def shingle_sets(texts: list[str | None], width: int = WORDS_PER_SHINGLE) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles: `width` consecutive words, or all of fewer."""
    coded = [t.encode("utf-8", "replace").translate(LOWER_BYTES) if t else b"" for t in texts]
    buffer = np.frombuffer(b" ".join(coded) + b" ", dtype=np.uint8)
    space = _SPACE[buffer]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buffer) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    first = np.cumsum([0] + [len(c) + 1 for c in coded])
    at = np.searchsorted(starts, first)  # words of text i: at[i] to at[i + 1]
    words = range_hashes(prefix_sums(buffer), starts, ends)
    n = len(words)
    joined = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + words[k : n - width + 1 + k]) if len(joined) else joined
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            h = np.zeros(1, dtype=np.uint64)
            for k in range(a, b):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + 1])
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], values: int = ROWS * BANDS) -> np.ndarray:
    """Row i: the least value of each hash function over set i; sets aren't empty."""
    out = np.empty((len(sets), values), dtype=np.uint32)
    if not sets:
        return out
    every = np.concatenate(sets)
    x = (every ^ (every >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    h = np.empty_like(x)
    for k in range(values):
        np.add(x, _ADD[k], out=h)
        h ^= h >> np.uint32(15)
        h *= _MUL[k]
        h ^= h >> np.uint32(13)
        np.minimum.reduceat(h, starts, out=out[:, k])
    return out


def band_hashes(sig: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    out = np.empty((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, dtype=np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, k].astype(np.uint64))
        out[:, b] = h
    return out


def least_matches(threshold: float = THRESHOLD / 100, miss: float = MISS, values: int = ROWS * BANDS) -> list[tuple[int, int]]:
    """(compared values n, least matches): with fewer, P(similarity >= threshold | matches, n) < miss, from a uniform prior.
    Values are compared by their last byte, which is equal by chance once in 256."""
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in range(STEP, values + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() / weight.sum() >= miss:
                break
        out.append((n, m))
    return out


def surviving(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) that no look prunes. Values are compared in steps; pruned pairs go no further."""
    matches, done = np.zeros(len(i), dtype=np.int32), 0
    for n, least in bounds:
        matches = matches + (left[i, done:n] == right[j, done:n]).sum(axis=1, dtype=np.int32)
        ok = matches >= least
        i, j, matches, done = i[ok], j[ok], matches[ok], n
    return i, j


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node that it is connected with), for the nodes of the edges a, b.

    Large-star and small-star steps, each a minimum per node and a join; nodes with very many edges are joined where those are.
    Every step is written to the checkpoint folder; the driver sees a count and a checksum."""
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, seen = e.count(), None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
        large = join_hot(both, least, ["a"], 2 * n, "_n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label"))
        n, seen = now[0], now


def _list_of(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.uint64).view(np.int64)))


def _describe(plan: Plan):
    """rid, rk, nid, n, two fingerprints of the set, its band hashes."""

    def work(batches):
        for b in (part for whole in batches for part in slices(whole, TEXT_BYTES, "text")):
            sets = shingle_sets(b.column("text").to_pylist(), plan.width)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            some = [i for i, s in enumerate(sets) if len(s)]
            bands = band_hashes(signatures([sets[i] for i in some], plan.values), plan.rows, plan.bands)
            listed: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(sets)
            for row, i in zip(bands, some, strict=True):
                listed[i] = row
            marks = [np.array([mix(s + np.uint64(k)).sum() for s in sets], dtype=np.uint64).view(np.int64) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("rk"), b.column("nid"), pa.array(n), pa.array(marks[0]), pa.array(marks[1]), _list_of(listed)],
                names=["rid", "rk", "nid", "n", "f1", "f2", "bands"],
            )

    return work


def _members(plan: Plan):
    """nid, signature, shingles of the documents that share a band with another."""

    def work(batches):
        for b in (part for whole in batches for part in slices(whole, TEXT_BYTES, "text")):
            sets = shingle_sets(b.column("text").to_pylist(), plan.width)
            sig = signatures(sets, plan.values)
            yield pa.RecordBatch.from_arrays([b.column("nid"), pa.array([r.tobytes() for r in (sig & 0xFF).astype(np.uint8)], pa.binary()), _list_of(sets)], names=["nid", "sig", "shingles"])

    return work


def _prune(plan: Plan):
    bounds = least_matches(plan.threshold / 100, values=plan.values)

    def work(batches):
        for b in batches:
            left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(b.num_rows, plan.values) for c in ("sig_u", "sig_v"))
            every = np.arange(b.num_rows)
            i, _ = surviving(left, right, every, every, bounds)
            yield pa.RecordBatch.from_arrays([b.column("u").take(pa.array(i)), b.column("v").take(pa.array(i))], names=["u", "v"])

    return work


def _strays(plan: Plan):
    """Links of strays to block members with other labels: one for every two labels that they join.

    Pairs that survive pruning are compared on their full sets here, and labels that a link joins count as one from
    then on, so that what leaves the task is no more than the labels that came in."""
    bounds, threshold = least_matches(plan.threshold / 100, values=plan.values), plan.threshold

    def side(table: pa.Table, mark: str) -> tuple[np.ndarray, ...]:
        sig = np.frombuffer(b"".join(table.column("sig" + mark).to_pylist()), dtype=np.uint8).reshape(table.num_rows, plan.values)
        lists = table.column("shingles" + mark).combine_chunks()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy().view(np.uint64)
        return sig, table.column("nid" + mark).to_numpy(), table.column("label" + mark).to_numpy(), offsets, values

    def work(strays: pa.Table, members: pa.Table) -> pa.Table:
        links = []
        if strays.num_rows and members.num_rows:
            # Sets are in the order of unsigned numbers; seen as such, searchsorted holds.
            s_sig, s_nid, s_label, s_off, s_val = side(strays, "")
            m_sig, m_nid, m_label, m_off, m_val = side(members, "_")
            _, root = np.unique(np.concatenate((s_label, m_label)), return_inverse=True)
            own, other = root[: len(s_nid)], root[len(s_nid) :]
            size = np.diff(m_off)
            for r in range(len(s_nid)):
                far = np.flatnonzero(other != own[r])
                _, j = surviving(s_sig, m_sig, np.full(len(far), r), far, bounds)
                mine = s_val[s_off[r] : s_off[r + 1]]
                n = len(mine)
                j = j[(100 * np.minimum(size[j], n) >= threshold * np.maximum(size[j], n))]
                if not len(j):
                    continue
                flat = np.concatenate([m_val[m_off[x] : m_off[x + 1]] for x in j])
                at = np.minimum(np.searchsorted(mine, flat), n - 1)
                starts = np.cumsum(size[j]) - size[j]
                inter = np.add.reduceat((mine[at] == flat).astype(np.int64), starts)
                for x in j[100 * inter >= threshold * (n + size[j] - inter)]:
                    if other[x] != own[r]:
                        links.append((min(s_nid[r], m_nid[x]), max(s_nid[r], m_nid[x])))
                        was, now = other[x], own[r]
                        own[own == was] = now
                        other[other == was] = now
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return work


def _verified(pairs: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    v = members.select(F.col("nid").alias("v"), F.col("shingles").alias("sv"))
    u = members.select(F.col("nid").alias("u"), F.col("shingles").alias("su"))
    both = pairs.join(v, "v").join(u, "u")
    inter = F.size(F.array_intersect("su", "sv"))
    return both.filter(inter * 100 >= (F.size("su") + F.size("sv") - inter) * threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, width: int = WORDS_PER_SHINGLE) -> DataFrame:
    """One row per document: id, rk, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their shingle sets (`width` words, A-Z lower-cased) is at least
    threshold / 100; component_id is the smallest id among all that are reachable over links, and `kept` marks one row
    of every component. A document of fewer words is one shingle; one without words is linked with nothing and kept.
    Documents with equal sets are one class throughout and meet as one representative. Rows that share an id are told
    apart by rk, in the order of their text; the first is kept. A null id comes after all others; its component_id is
    null unless a document with an id is reachable. An empty table gives no rows. Other columns aren't read. A text of any
    length counts with all its shingles.

    Candidates share a band of their signatures; bands and pruning follow the threshold. First every document meets the least and the greatest one of its buckets.
    Then, in buckets whose members aren't yet in one component, those outside the bucket's largest component (strays) meet
    all others, block by block; of components of one size the one with the largest label counts as the largest. A pair is left out only if both are in one component already. Links hold on full sets.
    Classes, buckets and components of very many documents are joined where their rows are."""
    plan = Plan.of(width, threshold)
    rows = evened(keyed(docs, id_col, text_col))
    rows = rows.withColumn("nid", F.when(F.col("rk") == 0, F.col("rid")).otherwise(F.xxhash64("rid", "rk")))
    base = cut(map_arrow(rows.select("rid", "rk", "nid", "text"), _describe(plan), "rid long, rk int, nid long, n long, f1 long, f2 long, bands array<long>"))
    some = base.filter("n > 0")
    n_docs = base.count()
    classes = cut(some.groupBy("f1", "f2", "n").agg(F.min("nid").alias("rep"), F.count(F.lit(1)).alias("size")))
    reps = some.join(classes.select(F.col("rep").alias("nid")), "nid", "left_semi")
    bands = cut(reps.select("nid", F.explode("bands").alias("band")))
    shared = cut(bands.groupBy("band").agg(F.min("nid").alias("hub"), F.max("nid").alias("last"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    n_bands = classes.count() * plan.bands
    buckets = cut(join_hot(bands, shared, ["band"], n_bands, "size"))
    ids = buckets.select("nid").distinct()
    members = cut(map_arrow(rows.select("nid", "text").join(ids, "nid", "left_semi"), _members(plan), "nid long, sig binary, shingles array<long>"))

    ends = buckets.groupBy("nid").agg(F.min("hub").alias("hub"), F.max("last").alias("last"))
    stars = ends.select("nid", F.explode(F.array("hub", "last")).alias("end")).filter("nid <> end").select(F.least("nid", "end").alias("u"), F.greatest("nid", "end").alias("v")).distinct()
    sig = members.select("nid", "sig")
    pairs = stars.join(sig.select(F.col("nid").alias("v"), F.col("sig").alias("sig_v")), "v").join(sig.select(F.col("nid").alias("u"), F.col("sig").alias("sig_u")), "u")
    links = cut(_verified(map_arrow(pairs.select("u", "v", "sig_u", "sig_v"), _prune(plan), "u long, v long"), members, threshold))
    labels = components(links)

    named = cut(buckets.select("band", "nid", "size").join(labels.select(F.col("node").alias("nid"), "label"), "nid", "left").withColumn("label", F.coalesce("label", "nid")))
    sizes = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"))
    open_ = cut(sizes.groupBy("band").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("k", "label")).alias("main"), F.sum("k").alias("_k")).filter("labels > 1"))
    met = cut(join_hot(named, open_, ["band"], n_bands, "_k").select("band", "nid", "label", "main", F.pmod(F.xxhash64("nid"), F.ceil(F.col("size") / BLOCK)).cast("int").alias("block")))
    stray = met.filter("label <> main")
    tasks = stray.select("band", F.col("block").alias("i")).distinct().join(met.select("band", F.col("block").alias("j")).distinct(), "band")
    left = stray.withColumnRenamed("block", "i").join(tasks, ["band", "i"]).join(members, "nid").select("band", "i", "j", "nid", "label", "sig", "shingles")
    right = met.withColumnRenamed("block", "j").join(tasks, ["band", "j"]).join(members, "nid").select("band", "i", "j", "nid", "label", "sig", "shingles")
    right = right.toDF(*(f"{c}_" for c in right.columns))
    more = left.groupBy("band", "i", "j").cogroup(right.groupBy("band_", "i_", "j_")).applyInArrow(_strays(plan), "a long, b long")
    labels = components(links.unionByName(more))

    named = cut(classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").select("f1", "f2", "n", F.coalesce("label", "rep").alias("label"), "size"))
    out = cut(join_hot(base.select("rid", "rk", "nid", "n", "f1", "f2"), named, ["f1", "f2", "n"], n_docs, "size", "left").select("rid", "rk", "n", F.coalesce("label", "nid").alias("label")))
    heads = cut(out.groupBy("label").agg(F.min(F.struct("rid", "rk")).alias("head"), F.count(F.lit(1)).alias("size")))
    out = join_hot(out, heads, ["label"], n_docs, "size")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(
        real("rid").alias(id_col),
        "rk",
        F.col("n").alias("n_shingles"),
        real("head.rid").alias("component_id"),
        (F.struct("rid", "rk") == F.col("head")).alias("kept"),
    )
