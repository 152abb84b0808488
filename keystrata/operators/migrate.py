"""Copying a table to a new generation: passes in segments that can be resumed, conflicts by kind, stale holders that give way,
and a last pass before readers are switched over.

Every step is a frame of the source's rows against frames of what is copied. Rows that can't be copied are conflicts, each with a
kind and a record under a key of its own; they are tried again in every later pass, after what is gone from the source was removed."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.keys import item_key, lengths_ok
from keystrata.model import Entity
from keystrata.operators import cost, derive
from keystrata.operators.evolve import Convert, converted, stale, to_copy
from keystrata.operators.reads import segment_of
from keystrata.operators.writes import missing_required

# Kinds of conflicts, in the order in which a row's first one is told.
KINDS = ("required", "key_too_long", "same_key", "claim_taken", "limit", "too_many_items")
MAX_ITEMS = 100
# End of fixed values.


def items_of(e: Entity) -> Column:
    """Items that a row's copy writes: itself, a claim for each unique value, its copies and counters, and the fence."""
    n = F.lit(2 + len(e.counters) + sum(i.strategy == "copy" for i in e.indexes))
    for u in e.uniques:
        n = n + (F.coalesce(cost.held_elements(u.element), F.lit(0)) if u.element else F.lit(1))
    return n


def claims_of(rows: DataFrame, e: Entity) -> DataFrame:
    """claim and owner (src_pk, src_sk) for every unique value of the rows."""
    out = None
    for u in e.uniques:
        held = derive.claims(rows, e, u.name).join(rows.select(*e.key_fields, "src_pk", "src_sk"), e.key_fields)
        part = held.select(F.concat_ws("\u0000", F.lit(u.name), "PK", "SK").alias("claim"), "src_pk", "src_sk")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.select(F.lit("").alias("claim"), "src_pk", "src_sk").limit(0)


def conflicts(rows: DataFrame, copied: DataFrame, e: Entity, limits: dict[str, int] | None = None) -> DataFrame:
    """src_pk, src_sk, conflict: rows that can't be copied beside what is, each with its first kind.

    same_key: several sources render to one key, or another source's copy has it. claim_taken: another source's copy, or an
    earlier row, holds a unique value. limit: a counter would rise above the limit given for its value; the first rows by
    key are let in. Groups are counted or ranked by key, so no key's rows are gathered."""
    keys, own = e.key_fields, ["src_pk", "src_sk"]
    pk, sk = item_key(e)
    found = rows.withColumn("_bad", F.when(missing_required(e), "required").when(~lengths_ok(pk, sk), "key_too_long").when(items_of(e) > MAX_ITEMS, "too_many_items"))
    out = found.filter("_bad is not null").select(*own, F.col("_bad").alias("conflict"))

    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twice = rows.join(many, keys, "left_semi").select(*own)
    others = copied.select(*keys, F.col("src_pk").alias("_p"), F.col("src_sk").alias("_s"))
    taken = rows.join(others, keys).filter("src_pk <> _p or src_sk <> _s").select(*own)
    out = out.unionByName(twice.unionByName(taken).withColumn("conflict", F.lit("same_key")))

    if e.uniques:
        mine = claims_of(rows, e)
        theirs = claims_of(copied, e).select("claim", F.col("src_pk").alias("_p"), F.col("src_sk").alias("_s"))
        held = mine.join(theirs, "claim").filter("src_pk <> _p or src_sk <> _s").select(*own)
        later = mine.withColumn("_r", F.row_number().over(Window.partitionBy("claim").orderBy(*own))).filter("_r > 1").select(*own)
        out = out.unionByName(held.unionByName(later).withColumn("conflict", F.lit("claim_taken")))

    fresh = rows.join(copied.select(*own), own, "left_anti")
    for c in e.counters:
        names = list(dict.fromkeys(c.pk.fields + c.sk.fields))
        for v in c.values:
            most = (limits or {}).get(f"{c.name}.{v.name}", v.limit if isinstance(v.limit, int) else None)
            if most is None or any(e.field(n).type == "string_set" for n in names):
                continue
            there = derive.counters_by_field(copied, e, c).select(*names, F.col(v.name).alias("_v"))
            one = F.coalesce(F.col(v.sum), F.lit(0)) if v.sum else F.lit(1)
            w = Window.partitionBy(*names).orderBy(*own).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ranked = fresh.withColumn("_sum", F.sum(one).over(w)).join(there, names, "left") if names else fresh.withColumn("_sum", F.sum(one).over(Window.orderBy(*own))).crossJoin(F.broadcast(there))
            over = ranked.filter(F.col("_sum") + F.coalesce("_v", F.lit(0)) > most).select(*own)
            out = out.unionByName(over.withColumn("conflict", F.lit("limit")))

    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("conflict"))
    return out.groupBy(*own).agg(F.min_by("conflict", order).alias("conflict"))


def displaced(rows: DataFrame, copied: DataFrame, e: Entity) -> DataFrame:
    """Copies that hold a key or a unique value which another source's row now has, while their own source no longer does:
    the source has moved on since they were copied, so they give way. src_pk, src_sk."""
    own = ["src_pk", "src_sk"]
    keys = e.key_fields
    wanted = rows.select(*keys, F.col("src_pk").alias("_p"), F.col("src_sk").alias("_s"))
    in_way = copied.join(wanted, keys).filter("src_pk <> _p or src_sk <> _s").select(*own, *keys)
    still = rows.select(*own, *keys)
    out = in_way.join(still, [*own, *keys], "left_anti").select(*own)
    if e.uniques:
        mine = claims_of(rows, e)
        held = claims_of(copied, e)
        asked = mine.select("claim", F.col("src_pk").alias("_p"), F.col("src_sk").alias("_s"))
        blocking = held.join(asked, "claim").filter("src_pk <> _p or src_sk <> _s").select("claim", *own)
        out = out.unionByName(blocking.join(mine, ["claim", *own], "left_anti").select(*own))
    return out.distinct()


@dataclass
class Progress:
    """What a run has done; as JSON it is the checkpoint from which another goes on."""

    segments: int
    done: list[int] = field(default_factory=list)
    copied: int = 0
    removed: int = 0
    passes: int = 0
    finished: bool = False

    def text(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def of(text: str | None, segments: int) -> Progress:
        return Progress(**json.loads(text)) if text else Progress(segments)


class Migration:
    """One entity's way to a new generation. read_source gives the source's rows now; load and save the copies as they are stored;
    keep stores the checkpoint's text. Whoever runs it next, after a loss, goes on with the segments that aren't done."""

    def __init__(
        self,
        old: Entity,
        new: Entity,
        read_source: Callable[[], DataFrame],
        load: Callable[[], DataFrame],
        save: Callable[[DataFrame], None],
        keep: Callable[[str], None],
        progress: str | None = None,
        segments: int = 16,
        convert: Convert | None = None,
        limits: dict[str, int] | None = None,
    ):
        self.old, self.new, self.convert, self.limits = old, new, convert, limits
        self.read_source, self.load, self.save, self.keep = read_source, load, save, keep
        self.progress = Progress.of(progress, segments)

    def source(self) -> DataFrame:
        return converted(self.read_source(), self.old, self.new, self.convert)

    def step(self, rows: DataFrame, everything: DataFrame) -> dict[str, int]:
        """Removes copies that are stale or in the way, then copies what can be copied of `rows`. everything: all source rows."""
        own = ["src_pk", "src_sk"]
        copied = self.load()
        gone = stale(copied, everything, self.new.key_fields).select(*own).unionByName(displaced(rows, copied, self.new)).distinct()
        left = copied.join(gone, own, "left_anti")
        bad = conflicts(rows, left, self.new, self.limits)
        good = rows.join(bad, own, "left_anti")
        fresh = to_copy(good, left)
        n = {"copied": fresh.count(), "removed": gone.count(), "conflicts": bad.count()}
        if n["copied"] or n["removed"]:
            self.save(left.join(fresh.select(*own), own, "left_anti").unionByName(fresh.select(*left.columns)))
        self.progress.copied += n["copied"]
        self.progress.removed += n["removed"]
        return n

    def bulk(self, most_segments: int | None = None) -> list[int]:
        """The first pass, segment by segment, with a checkpoint after each. Returns the segments that are still to be done."""
        p = self.progress
        for i in [i for i in range(p.segments) if i not in p.done][:most_segments]:
            rows = self.source()
            self.step(rows.filter(segment_of(F.col("src_pk"), p.segments) == i), rows)
            p.done.append(i)
            self.keep(p.text())
        return [i for i in range(p.segments) if i not in p.done]

    def catch_up(self, most_passes: int = 3) -> list[dict[str, int]]:
        """Passes over all rows until one changes nothing."""
        out = []
        for _ in range(most_passes):
            rows = self.source()
            out.append(self.step(rows, rows))
            self.progress.passes += 1
            self.keep(self.progress.text())
            if not out[-1]["copied"] and not out[-1]["removed"]:
                break
        return out

    def finish(self) -> DataFrame:
        """The last pass, with the source closed for writing: src_pk, src_sk, conflict and the record's key of what can't be
        copied. Finished if a pass changes nothing and no conflicts are left."""
        if left := [i for i in range(self.progress.segments) if i not in self.progress.done]:
            raise ValueError(f"{len(left)} segments haven't been copied")
        rows = self.source()
        n = self.step(rows, rows)
        if n["copied"] or n["removed"]:
            rows = self.source()
            n = self.step(rows, rows)
        self.progress.finished = not any(n.values())
        self.keep(self.progress.text())
        bad = conflicts(rows, self.load(), self.new, self.limits)
        return bad.withColumn("record", record_key("src_pk", "src_sk"))


def record_key(pk: str, sk: str) -> Column:
    """As `evolve.conflict_key`, as a column."""
    text = F.concat(F.length(pk).cast("string"), F.lit("#"), F.col(pk), F.col(sk))
    return F.when(F.octet_length(text) <= 1024, text).otherwise(F.sha2(text, 256))
