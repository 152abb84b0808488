"""Derived items: counters, claims and copies of an entity's rows, and what a change of rows does to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.keys import item_key, lowered_elements, present, render, shard_key, shard_of
from keystrata.functions.preds import holds
from keystrata.model import Counter, Entity


def _element_of(e: Entity, *names: str) -> str:
    return next((n for n in names if e.field(n).type == "string_set"), "")


def _exploded(rows: DataFrame, e: Entity, names: list[str], lower: bool = False) -> tuple[DataFrame, tuple[str, Column] | None]:
    """A row for every distinct element of the set field among the names, if there is one."""
    name = _element_of(e, *names)
    if not name:
        return rows, None
    values = lowered_elements(F.col(name)) if lower else F.col(name)
    return rows.withColumn("_element", F.explode(F.array_distinct(values))).filter("_element <> ''"), (name, F.col("_element"))


def contributions(rows: DataFrame, e: Entity, c: Counter) -> DataFrame:
    """PK, SK, owner and an amount for every value of the counter, from each row that its key fields let contribute."""
    names = c.pk.fields + c.sk.fields
    rows, element = _exploded(rows, e, names)
    rows = rows.filter(present(e, c.pk, c.sk, element=element))
    pk, sk = render(c.pk, e, element), render(c.sk, e, element)
    if c.shards > 1:
        pk = shard_key(pk, shard_of(*item_key(e), c.shards), c.shards)
    amounts = []
    for v in c.values:
        amount = F.coalesce(F.col(v.sum).cast("bigint"), F.lit(0)) if v.sum else F.lit(1).cast("bigint")
        amounts.append(F.when(holds(e, v.where), amount).otherwise(F.lit(0).cast("bigint")).alias(v.name))
    return rows.select(pk.alias("PK"), sk.alias("SK"), *amounts)


def counter_items(rows: DataFrame, e: Entity, c: Counter, fields: bool = False) -> DataFrame:
    """The counter's items: sums by key, added up before they are shuffled. Shards stay apart, by the owner's hash."""
    if fields:
        return counters_by_field(rows, e, c)
    return contributions(rows, e, c).groupBy("PK", "SK").agg(*(F.sum(v.name).alias(v.name) for v in c.values))


def counters_by_field(rows: DataFrame, e: Entity, c: Counter) -> DataFrame:
    """The same, by native key fields and without rendering; shards are only a way to add up in two steps."""
    names = list(dict.fromkeys(c.pk.fields + c.sk.fields))
    rows, element = _exploded(rows, e, names)
    rows = rows.filter(present(e, c.pk, c.sk, element=element))
    keys = [element[1].alias(n) if element and n == element[0] else F.col(n) for n in names]
    aggs = []
    for v in c.values:
        amount = F.coalesce(F.col(v.sum).cast("bigint"), F.lit(0)) if v.sum else F.lit(1).cast("bigint")
        aggs.append(F.sum(F.when(holds(e, v.where), amount).otherwise(0)).alias(v.name))
    return rows.groupBy(*keys).agg(*aggs)


def sharded_totals(rows: DataFrame, e: Entity, c: Counter) -> DataFrame:
    """Counter items by shard, then their sum: a hot counter's rows never meet in one task."""
    names = list(dict.fromkeys(c.pk.fields + c.sk.fields))
    shard = shard_of(*item_key(e), c.shards).alias("shard")
    aggs = [F.sum(F.when(holds(e, v.where), F.lit(1) if not v.sum else F.col(v.sum)).otherwise(0)).alias(v.name) for v in c.values]
    parts = rows.filter(present(e, c.pk, c.sk)).groupBy(*names, shard).agg(*aggs)
    return parts.groupBy(*names).agg(*(F.sum(v.name).alias(v.name) for v in c.values), F.count(F.lit(1)).alias("shards_used"))


def counter_delta(before: DataFrame, after: DataFrame, e: Entity, c: Counter) -> DataFrame:
    """After less before for every counter item; what adds up to nothing is left out. Owners' changes come together."""
    signed = []
    for sign, rows in ((-1, before), (1, after)):
        parts = contributions(rows, e, c)
        signed.append(parts.select("PK", "SK", *((F.col(v.name) * sign).alias(v.name) for v in c.values)))
    total = signed[0].unionByName(signed[1]).groupBy("PK", "SK").agg(*(F.sum(v.name).alias(v.name) for v in c.values))
    moved = F.lit(False)
    for v in c.values:
        moved = moved | (F.col(v.name) != 0)
    return total.filter(moved)


def kept_counters(previous: DataFrame, now: DataFrame, values: list[str]) -> DataFrame:
    """Counter items once made stay, at zero."""
    old = previous.select("PK", "SK")
    return old.join(now, ["PK", "SK"], "full").select("PK", "SK", *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def claims(rows: DataFrame, e: Entity, name: str) -> DataFrame:
    """PK and SK of the claim, and its owner's key fields. Every element of a unique set is a claim of its own."""
    u = e.unique(name)
    rows, element = _exploded(rows, e, list(u.fields))
    rows = rows.filter(present(e, u.pk, u.sk, element=element))
    shown = [n for n in dict.fromkeys([*e.key_fields, *u.fields]) if n != u.element] + (["_element"] if element else [])
    return rows.select(render(u.pk, e, element).alias("PK"), render(u.sk, e, element).alias("SK"), *shown)


def claim_conflicts(rows: DataFrame, e: Entity, name: str) -> DataFrame:
    """Claims that several owners make."""
    return claims(rows, e, name).groupBy("PK", "SK").agg(F.count(F.lit(1)).alias("owners")).filter("owners > 1")


def claim_changes(before: DataFrame, after: DataFrame, e: Entity, name: str) -> DataFrame:
    """PK, SK and op: `put` for claims that are new or change owner, `delete` for those that nobody makes any more."""
    key = list(e.key_fields)
    old = claims(before, e, name).select("PK", "SK", F.struct(*key).alias("was"))
    new = claims(after, e, name).select("PK", "SK", F.struct(*key).alias("now"))
    both = old.join(new, ["PK", "SK"], "full")
    return both.select("PK", "SK", F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull() | ~F.col("was").eqNullSafe(F.col("now")), "put").alias("op")).filter("op is not null")


def copies(rows: DataFrame, e: Entity, name: str) -> DataFrame:
    """PK and SK of an index's copies and their projected fields."""
    ix = e.index(name)
    rows, element = _exploded(rows, e, ix.pk.fields + (ix.sk.fields if ix.sk else []), any(p.lower for p in ix.pk.parts))
    rows = rows.filter(present(e, ix.pk, ix.sk, element=element) & holds(e, ix.where))
    return rows.select(render(ix.pk, e, element).alias("PK"), render(ix.sk, e, element).alias("SK"), *e.projection(ix)).dropDuplicates(["PK", "SK"])


def copy_changes(before: DataFrame, after: DataFrame, e: Entity, name: str) -> DataFrame:
    """PK, SK and op: `put` for copies that are new or differ in any field, `delete` for those that are gone."""
    ix = e.index(name)
    fields = e.projection(ix)
    old = copies(before, e, name).select("PK", "SK", F.struct(*fields).alias("was"))
    new = copies(after, e, name).select("PK", "SK", F.struct(*fields).alias("now"))
    both = old.join(new, ["PK", "SK"], "full")
    return both.select("PK", "SK", F.when(F.col("now").isNull(), "delete").when(~F.col("was").eqNullSafe(F.col("now")), "put").alias("op")).filter("op is not null")


def all_derived(rows: DataFrame, e: Entity) -> DataFrame:
    """Every derived item of the rows: PK, SK, kind and name."""
    out = None
    for kind, names in (("counter", e.counters), ("claim", e.uniques), ("copy", [i for i in e.indexes if i.strategy == "copy"])):
        for x in names:
            part = counter_items(rows, e, x) if kind == "counter" else claims(rows, e, x.name) if kind == "claim" else copies(rows, e, x.name)
            part = part.select("PK", "SK", F.lit(kind).alias("kind"), F.lit(x.name).alias("name"))
            out = part if out is None else out.unionByName(part)
    return out


def same_items(a: DataFrame, b: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """key and `same`: whether both sides' items agree in all fields, nulls included; an item of one side only differs."""
    x = a.select(*key, F.struct(*fields).alias("_a"))
    y = b.select(*key, F.struct(*fields).alias("_b"))
    return x.join(y, key, "full").select(*key, F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


def distinct_keys(rows: DataFrame, names: list[str]) -> DataFrame:
    """Keys once each, in key order where they are read."""
    return rows.select(*names).dropDuplicates().sortWithinPartitions(*names)
