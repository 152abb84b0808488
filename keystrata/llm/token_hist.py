"""Exact histogram of encoded lengths; suffix sums answer every context limit."""

from __future__ import annotations

import base64

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.common import cut, per_text

#: Lengths that one task sums up.
BLOCK = 4096

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str, ranks: bytes, pattern: str) -> tiktoken.Encoding:
    if path not in _encodings:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _encodings[path] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encodings[path]


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, `keep` columns and n_tokens of every row. A null or empty text has 0 tokens; strings of special tokens are plain
    text. An empty table gives no rows; repeated rows stay repeated. Texts are encoded whole. Other columns aren't read; a
    kept one that is named n_tokens gets _in appended."""
    ranks = open(ranks_path, "rb").read()  # noqa: SIM115
    cast = docs.sparkSession.sparkContext.broadcast(ranks)

    def work(texts):
        enc = encoding(ranks_path, cast.value, pattern)
        return [pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())]

    return per_text(docs, work, "n_tokens long", id_col, text_col, keep)


def length_histogram(counts: DataFrame) -> DataFrame:
    """n_tokens, n_docs: one row per length. Rows are added up before they are shuffled; repeated rows count each.

    The rows are written to the checkpoint folder, so that whatever asks them doesn't encode the texts again."""
    return cut(counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every length L that occurs, as a context limit: docs_over and tokens_over (documents longer than L and
    their tokens), docs_within, tokens_within, truncated_total (tokens if every document is cut at L), and quantile
    (the share of documents no longer than L).

    Sums run inside blocks of lengths, in parallel, and over one row per block. An empty histogram gives no rows. Lengths
    differ from each other, so there are no ties; other columns of the histogram aren't read."""
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("_t"), F.floor(F.col("n_tokens") / block).alias("_b"))
    blocks = h.groupBy("_b").agg(F.sum("n_docs").alias("_d"), F.sum("_t").alias("_bt"))
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "_b",
        F.coalesce(F.sum("_d").over(above), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_bt").over(above), F.lit(0)).alias("_tokens_above"),
        F.sum("_d").over(every).alias("_docs"),
        F.sum("_bt").over(every).alias("_tokens"),
    )
    inside = Window.partitionBy("_b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = h.join(blocks, "_b").select(
        "n_tokens",
        "n_docs",
        (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("_docs_above")).alias("docs_over"),
        (F.coalesce(F.sum("_t").over(inside), F.lit(0)) + F.col("_tokens_above")).alias("tokens_over"),
        "_docs",
        "_tokens",
    )
    return over.select(
        "n_tokens",
        "n_docs",
        "docs_over",
        "tokens_over",
        (F.col("_docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("_tokens") - F.col("tokens_over")).alias("tokens_within"),
        (F.col("_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
        ((F.col("_docs") - F.col("docs_over")) / F.col("_docs")).alias("quantile"),
    )


def answer_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_over, tokens_within, truncated_total for any limits, also those that are no document's length."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    total = sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("_n"))
    at = asked.join(sums, F.col("n_tokens") <= F.col("context_limit"), "left").groupBy("context_limit").agg(F.max_by(F.struct("docs_over", "tokens_within"), "n_tokens").alias("s"))
    return at.crossJoin(total).select(  # one row
        "context_limit",
        F.coalesce("s.docs_over", "_n").alias("docs_over"),
        F.coalesce("s.tokens_within", F.lit(0)).alias("tokens_within"),
        (F.coalesce("s.tokens_within", F.lit(0)) + F.col("context_limit") * F.coalesce("s.docs_over", "_n")).alias("truncated_total"),
    )


def quantile_lengths(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of the documents doesn't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return asked.join(sums, F.col("quantile") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
