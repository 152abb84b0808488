"""Language mixtures: expectation-maximisation over words whose likelihoods come from character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import evened, map_arrow, named, per_text
from keystrata.llm.rolling import mix

#: Buckets of hashed n-grams: the model is this many counts for each language, whatever the corpus.
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Expectation-maximisation ends when no share moves by more, or after this many steps; texts that are done leave every few.
MOVE, MOST_STEPS, LOOK = 1e-3, 200, 4
#: Log-likelihood that a further language must add, times log(words).
PENALTY = 3.0
#: Numbers in a matrix of words by languages.
CELLS = 2_000_000

_letters: dict[int, np.ndarray] = {}


def letter_table() -> np.ndarray:
    if 0 not in _letters:
        _letters[0] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter of all texts the bucket of it and its neighbours; where words begin among those; and where the
    words of each text begin, with the end. Words are runs of letters, in lower case; what is no letter counts as a border."""
    lowered = [t.lower() if t else "" for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    sizes = np.array([len(t) + 1 for t in lowered])
    letter = letter_table()[points]
    c = np.where(letter, points, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    h = mix((c[at - 1] * np.uint64(0x9E3779B97F4A7C15) + c[at]) * np.uint64(0xBF58476D1CE4E5B9) + c[at + 1])
    bucket = (h >> np.uint64(48)).astype(np.int64)
    begins = np.flatnonzero(~letter[at - 1])
    first_point = np.append(np.cumsum(sizes) - sizes, sizes.sum()) + 1
    return bucket, begins, np.searchsorted(at[begins], first_point)


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS by languages

    @staticmethod
    def of_counts(rows: list[tuple[str, int, int]]) -> LanguageModel:
        languages = sorted({r[0] for r in rows})
        place = {x: i for i, x in enumerate(languages)}
        counts = np.full((BUCKETS, len(languages)), SMOOTHING)
        for lang, bucket, n in rows:
            counts[bucket, place[lang]] += n
        return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))

    def mixtures(self, texts: list[str | None]) -> list[dict[str, float] | None]:
        """Proportions of the chosen languages, the largest first; None for a text without letters."""
        out: list[dict[str, float] | None] = [None] * len(texts)
        if not self.languages:
            return out
        bucket, begins, first = grams(texts)
        n_lang = len(self.languages)
        most = max(1, CELLS // n_lang)
        docs = np.flatnonzero(np.diff(first) > 0)
        at = 0
        while at < len(docs):
            end = at + 1
            while end < len(docs) and first[docs[end] + 1] - first[docs[at]] <= most:
                end += 1
            part = docs[at:end]
            lo, hi = first[part[0]], first[part[-1] + 1]
            g0, g1 = begins[lo], begins[hi] if hi < len(begins) else len(bucket)
            like = np.add.reduceat(self.log_p[bucket[g0:g1]], begins[lo:hi] - g0, axis=0).astype(np.float64)
            for d, mix_ in zip(part, self.infer(like, first[part] - lo), strict=True):
                out[d] = mix_
            at = end
        return out

    def infer(self, like: np.ndarray, starts: np.ndarray) -> list[dict[str, float]]:
        """like: log-likelihood of words (rows) by languages; the words of document i begin at starts[i].

        The set begins with the best language alone. Each round adds the language that raises the penalised likelihood
        most, or drops one if that raises it, until neither does. The likelihood of the shares of a set has one maximum,
        so the start doesn't matter."""
        n_docs, n_lang = len(starts), like.shape[1]
        sizes = np.diff(np.append(starts, len(like)))
        top = like.max(axis=1)
        p = np.exp(like - top[:, None])
        base = np.add.reduceat(top, starts)
        fine = PENALTY * np.log(sizes + 1)
        alone = np.add.reduceat(like, starts, axis=0)
        chosen = np.eye(n_lang, dtype=bool)[alone.argmax(axis=1)]
        best_share, best = chosen.astype(np.float64), alone.max(axis=1)

        def value_of(docs: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            share, likelihood = maximised(p, starts[docs], sizes[docs], sets)
            return share, likelihood + base[docs] - fine[docs] * (sets.sum(axis=1) - 1)

        def tried(docs: np.ndarray, add: bool) -> np.ndarray:
            """The texts whose set gets better by one language more, or less, changed so."""
            win, win_share, win_set = best[docs].copy(), best_share[docs].copy(), chosen[docs].copy()
            for c in range(n_lang):
                some = np.flatnonzero(chosen[docs, c] != add)
                if not len(some):
                    continue
                sets = chosen[docs[some]].copy()
                sets[:, c] = add
                share, value = value_of(docs[some], sets)
                better = value > win[some] + 1e-9
                at = some[better]
                win[at], win_share[at], win_set[at] = value[better], share[better], sets[better]
            changed = win > best[docs]
            at = docs[changed]
            best[at], best_share[at], chosen[at] = win[changed], win_share[changed], win_set[changed]
            return at

        open_ = np.arange(n_docs) if n_lang > 1 else np.zeros(0, dtype=np.int64)
        while len(open_):
            # No set's likelihood exceeds that of each word's best language; the penalty only grows.
            k = chosen[open_].sum(axis=1)
            open_ = open_[(k < n_lang) & (base[open_] - fine[open_] * k > best[open_])]
            open_ = tried(open_, True)
            less = open_
            while len(less):
                less = tried(less[chosen[less].sum(axis=1) > 2], False)
        out = []
        for row in best_share:
            o = np.argsort(-row, kind="stable")
            out.append({self.languages[i]: float(row[i]) for i in o if row[i] > 0})
        return out


def maximised(p: np.ndarray, starts: np.ndarray, sizes: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shares of each text's set of languages with the greatest likelihood, and its logarithm. Rows of p are words."""
    out = sets / sets.sum(axis=1, keepdims=True)
    value = np.zeros(len(starts))
    at, left, n = starts, np.arange(len(starts)), sizes
    share = out
    begin = np.cumsum(n) - n
    doc = np.repeat(np.arange(len(n)), n)
    q = p[np.repeat(at - begin, n) + np.arange(int(n.sum()))] if len(n) else p[:0]
    for step in range(MOST_STEPS):
        if not len(left):
            break
        joint = q * share[doc]
        total = joint.sum(axis=1) + 1e-300
        now = np.add.reduceat(joint / total[:, None], begin, axis=0) / n[:, None]
        done = np.abs(now - share).max(axis=1) <= MOVE
        if step == MOST_STEPS - 1:
            done[:] = True
        share = now
        if done.any() and (step % LOOK == LOOK - 1 or done.all() or step == MOST_STEPS - 1):
            words = done[doc]
            ends = np.cumsum(n[done]) - n[done]
            value[left[done]] = np.add.reduceat(np.log((q[words] * share[doc[words]]).sum(axis=1) + 1e-300), ends)
            out[left[done]] = share[done]
            q, left, n, share = q[~words], left[~done], n[~done], share[~done]
            begin = np.cumsum(n) - n
            doc = np.repeat(np.arange(len(n)), n)
    return out, value


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, bucket, n over all rows of lang and text; every task adds up its own first."""

    def work(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column("text").to_pylist(), np.array(b.column("lang").to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                bucket, _, _ = grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                total[lang] = total.get(lang, 0) + np.bincount(bucket, minlength=BUCKETS)
        for lang, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some].astype(np.int64))], names=["lang", "bucket", "n"])

    parts = map_arrow(labelled.select("lang", "text"), work, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """From all rows whose text and language are known. The driver gets at most BUCKETS counts for each language."""
    known = docs.select(named(lang_col).alias("lang"), named(text_col).alias("text")).filter("lang is not null and text is not null")
    return LanguageModel.of_counts([tuple(r) for r in gram_counts(evened(known)).collect()])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, `keep` columns, lang_pred, score, mixture (language -> share of the words).

    Shares are fitted by expectation-maximisation, to convergence. The set of languages grows from the best one: the
    language that raises the likelihood, less a penalty for each further language, most is added, and one whose loss raises
    it is dropped, until nothing does. lang_pred has the largest share, score
    is that share. A text that is null, empty or without letters is `und` with score 0 and an empty mixture, and so is
    every text if nothing was learned. Ties go to the language that sorts first. An empty table gives no rows. Rows are judged alone where they are read; repeated rows stay
    repeated, and a text of any length counts whole. Other columns aren't read; a kept one that is named like a result gets _in appended."""
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        found = cast.value.mixtures(texts)
        pred = [next(iter(m)) if m else "und" for m in found]
        score = [min(1.0, next(iter(m.values()))) if m else 0.0 for m in found]
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array([list((m or {}).items()) for m in found], pa.map_(pa.string(), pa.float64()))]

    return per_text(docs, work, "lang_pred string, score double, mixture map<string,double>", id_col, text_col, keep)
