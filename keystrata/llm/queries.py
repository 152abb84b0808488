"""The queries op1 to op10 and their SQL; each is a thin digest of its operator's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import decontaminate, html_text, langid, lbl_lm, licenses, neardup, quality_crf, spm, suffix_dedup, token_hist
from keystrata.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = spm.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return coded.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 3) == 1
    model = langid.learn(docs.filter(F.coalesce(~held, F.lit(True))))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_hist.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return token_hist.suffix_sums(token_hist.length_histogram(counts))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))
    found = lbl_lm.score(docs.withColumn("held_out", held), docs.filter(~held), keep=("held_out",))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_crf,
        op2_suffix_dedup,
        op3_decontaminate,
        op4_main_text,
        op5_sentencepiece,
        op6_licenses,
        op7_language_mixture,
        op8_near_duplicates,
        op9_token_histogram,
        op10_language_model,
    )
}

ORACLE_SQL = {
    "op2_suffix_dedup": r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM b WHERE n >= 100)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w),
p AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS q FROM r WHERE k > 1),
s AS (SELECT doc_id, i, sum(CASE WHEN q IS NULL OR i > q + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p),
d AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS e FROM s GROUP BY doc_id, run),
c AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y FROM d UNION ALL SELECT doc_id, max(e), NULL FROM d GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, n) - x)), '' ORDER BY x) AS kept FROM c JOIN b USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(e - a) AS removed, count(*) AS spans FROM d GROUP BY doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op3_decontaminate": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ig AS (SELECT item_id, w, least(13, len(w)) AS k FROM iw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ig)),
ks AS (SELECT DISTINCT k FROM wins),
dg AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, dg.k, item_id FROM dg JOIN wins ON dg.k = wins.k AND dg.g = wins.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.l, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op8_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) AS k FROM s GROUP BY g),
r AS (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f.k, s.g) AS p FROM s JOIN n USING (doc_id) JOIN f USING (g)),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
      WHERE a.p <= a.n - (85 * a.n + 99) // 100 + 1 AND b.p <= b.n - (85 * b.n + 99) // 100 + 1),
i AS (SELECT a, b, count(*) AS i FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.g = y.g GROUP BY a, b),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.node),
m AS (SELECT node, min(root) AS root FROM t GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, w.doc_id) AS component_id, coalesce(m.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = w.doc_id
""",
}
