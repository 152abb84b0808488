"""What the text operators share: Arrow batches of bounded size, checkpoints, row keys."""

from __future__ import annotations

import contextlib
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Lower-cases A-Z and keeps 0-9, a-z and every byte of a non-ASCII character; all else becomes a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Lower-cases A-Z only.
LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds the Arrow batches sent to Python, so that long texts don't add up. A session that has lower bounds keeps them."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        with contextlib.suppress(Exception):
            now = spark.conf.get(key)
            if not (now.isdigit() and 0 < int(now) <= value):
                spark.conf.set(key, str(value))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def slices(batch: pa.RecordBatch, most: int, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch in which a column of texts has about `most` bytes, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def named(column: str) -> Column:
    """A top-level column of this very name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def names_beside(carried: list[str], own: list[str]) -> list[str]:
    """Names for carried columns: their own, with _in appended as long as a result column or another has that name."""
    out: list[str] = []
    for c in carried:
        while c in own or c in out:
            c += "_in"
        out.append(c)
    return out


#: A task that reads this many times its share of the rows is one too large.
UNEVEN = 2


def evened(rows: DataFrame) -> DataFrame:
    """The rows, dealt to as many tasks as run at once if one task would read most of them: a file's row group can't be split, and
    what is made of a text takes longer than to move it. Only row counts are read to find out; rows that are spread stay."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    per = rows.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    most, total = per.agg(F.max("n"), F.sum("n")).first()
    return rows.repartition(tasks) if total and total > tasks and most * tasks > UNEVEN * total else rows


def carry(docs: DataFrame, text_col: str, carried: list[str], *more: Column) -> tuple[DataFrame, list[StructField]]:
    """The text as _text, then `more`, then the carried columns as _k0, _k1 and so on, with the fields of those."""
    given = docs.select(named(text_col).alias("_text"), *more, *(named(c).alias(f"_k{i}") for i, c in enumerate(carried)))
    return given, [StructField(f.name, f.dataType) for f in given.schema.fields[1 + len(more) :]]


def per_text(docs: DataFrame, work: Callable[[list[str | None]], list[pa.Array]], schema: str, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The id and kept columns of every row, with what `work` makes of the texts of a batch: an array for each field of
    the schema. A kept column that is named like a result column (or the id) gets _in appended to its name. Rows stay where
    they are read, but for `evened`."""
    result = StructType.fromDDL(schema)
    own = result.names
    carried = [id_col, *(c for c in dict.fromkeys(keep) if c != id_col)]
    given, fields = carry(docs, text_col, carried)
    given = evened(given)

    def batches_of(batches):
        for b in batches:
            made = work(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1, b.num_columns)), *made], names=[*b.schema.names[1:], *own])

    out = map_arrow(given, batches_of, StructType([*fields, *result.fields]))
    return out.select(*(F.col(f.name).alias(n) for f, n in zip(fields, names_beside(carried, own), strict=True)), *own)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, a temporary one, but only if all runs in one process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="keystrata-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and drops the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Keys that are broadcast for being hot, at most; the rows of a hot key, at least; and how many times that even a key that had
#: all rows could have without being much for a task.
HOT_KEYS, HOT_ROWS, FEW = 100_000, 1000, 50


def join_hot(left: DataFrame, right: DataFrame, on: list[str], n_rows: int, count: str, how: str = "inner") -> DataFrame:
    """left joined to right, which has one row for a key and in `count` how many of left's n_rows rows have it.

    Up to FEW times HOT_ROWS rows are joined as they are. Beyond, keys with HOT_ROWS rows and no less than a HOT_KEYS-th of all are broadcast, of which there can't be more than HOT_KEYS, so that
    their rows stay where they are; all others meet by a shuffle. Both sides are read more than once and should be written."""
    if n_rows <= HOT_ROWS * FEW:
        return left.join(right, on, how)
    hot = max(HOT_ROWS, -(-n_rows // HOT_KEYS))
    big = right.filter(F.col(count) >= hot)
    if not big.limit(1).count():
        return left.join(right, on, how)
    rest = left.join(F.broadcast(big.select(*on)), on, "left_anti").join(right.filter(F.col(count) < hot), on, how)
    return left.join(F.broadcast(big), on).unionByName(rest)


def crc_mod(column: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % n


#: Stands for a null id; such rows come after all others.
NO_ID = (1 << 63) - 1


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with two more columns, rid and rk, that together tell every row from every other. The rows' own columns of
    these names, if any, are dropped.

    rid is the id (NO_ID where it is null). rk is 0 where ids are unique; else rows that share an id
    are numbered in the order of their text, nulls first. Only the id column is read to find out. Many rows of one id (null, say)
    are ranked among those whose texts begin alike, after the counts of what sorts before, so that they don't meet in one task."""
    rows = docs.drop(*(c for c in ("rid", "rk") if c not in (id_col, text_col)))
    rows = rows.withColumn("rid", F.coalesce(named(id_col).cast("long"), F.lit(NO_ID)))
    repeated = rows.select("rid").groupBy("rid").count().filter("count > 1").limit(1).count()
    if not repeated:
        return rows.withColumn("rk", F.lit(0))
    # Two levels of beginnings: none has more rows beside it than begin alike, and counts take their place from there.
    text = F.coalesce(F.concat(F.lit("+"), named(text_col)), F.lit(""))
    rows = rows.withColumns({"_a": F.substring(text, 1, 3), "_b": F.substring(text, 1, 24)})
    fine = rows.groupBy("rid", "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
    coarse = fine.groupBy("rid", "_a").agg(F.sum("_n").alias("_n"))

    def before(*within: str, order: str) -> Column:
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_n").over(w), F.lit(0))

    coarse = coarse.select("rid", "_a", before("rid", order="_a").alias("_x"))
    fine = fine.withColumn("_y", before("rid", "_a", order="_b")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("rid", "_a", "_b").orderBy(named(text_col)))
    ranked = rows.withColumn("_r", inside).join(fine, ["rid", "_a", "_b"]).join(coarse, ["rid", "_a"])
    return ranked.withColumn("rk", (F.col("_r") - 1 + F.col("_x") + F.col("_y")).cast("int")).drop("_a", "_b", "_r", "_x", "_y")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns rid, rk and text of `numbered`."""
    rows = docs.select(named(id_col).alias("i"), named(text_col).alias("text"))
    return numbered(rows, "i", "text").select("rid", "rk", "text")


def original_id(column: str = "rid") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def text_bytes(scan_bytes: int, per_task: int, least: int) -> int:
    """Number of buckets so that one holds about per_task bytes of input."""
    return max(least, -(-scan_bytes // per_task))


def input_bytes(df: DataFrame, text_col: str) -> int:
    """The optimiser's size estimate of what is scanned, which needs no pass over it; where it knows none, the text's size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 59:
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
