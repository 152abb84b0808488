"""From raw documents to token ids: five stages, each over all rows that the one before kept.

Stages take the columns of documents; others are dropped. Rows with a null or empty text, or of fewer than 50 words, go in
the first stage; given to a later one they stay, near-duplicates of nothing and without repeats, hits or tokens. Repeated
rows, and rows with null ids, are rows of their own: of copies the first in the order of ids, then texts, stays. An empty
table stays empty. A text of any length is worked on whole. Ties are those of the operators that the stages call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import decontaminate, neardup, quality_crf, spm, suffix_dedup
from keystrata.llm.common import cut, numbered

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the line field keep."""
    found = quality_crf.quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=COLUMNS[1:])
    return found.filter("kept").select(*COLUMNS)


#: Words of a shingle, and percents of similarity from which documents are linked.
WIDTH, THRESHOLD = 5, 80


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near-duplicates: that of the smallest id."""
    first = neardup.near_duplicates(docs, threshold=THRESHOLD, width=WIDTH).filter("kept").select(F.coalesce("doc_id", F.lit(neardup.NO_ID)).alias("rid"), "rk")
    return numbered(docs).join(first, ["rid", "rk"], "left_semi").select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that stand earlier; n_chars is that of what is left."""
    left = suffix_dedup.remove_repeats(docs).select(F.coalesce("doc_id", F.lit(neardup.NO_ID)).alias("rid"), "rk", F.col("kept").alias("new_text"))
    rest = numbered(docs).select("rid", "rk", "doc_id", "lang", "source")
    out = rest.join(left, ["rid", "rk"])
    return out.select("doc_id", F.col("new_text").alias("text"), "lang", "source", F.length("new_text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in windows of benchmark items."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS[1:])
    return found.filter(~decontaminate.contaminated()).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of what they decode to."""
    import public_tokenizers

    coded = spm.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("lang", "source"), digest=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("suffix-array dedup", suffix_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("sentencepiece", tokenize),
]

#: The line field's decisions can't be written in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage returns is written to the checkpoint folder, so that it is worked out once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
