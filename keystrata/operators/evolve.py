"""Schema versions: storage shapes, what changed between designs, and copying items to a new generation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.functions.keys import item_key, lengths_ok
from keystrata.model import MAX_SK, Entity
from keystrata.operators import cost
from keystrata.operators.writes import missing_required

SIGNIFICANT = 0.10


def shape(e: Entity) -> dict[str, Any]:
    """Everything about an entity that stored items depend on."""
    return {
        "entity": e.name,
        "version": e.version,
        "fields": {f.name: {"type": f.type, "attr": f.attribute, "values": sorted(f.values), "required": f.required} for f in e.fields},
        "pk": e.pk.raw,
        "sk": e.sk.raw,
        "ttl": e.ttl,
        "indexes": {i.name: {"pk": i.pk.raw, "sk": i.sk.raw if i.sk else "", "strategy": i.strategy, "where": str(i.where), "fields": sorted(e.projection(i))} for i in e.indexes},
        "uniques": {u.name: {"fields": list(u.fields), "pk": u.pk.raw, "sk": u.sk.raw} for u in e.uniques},
        "counters": {c.name: {"pk": c.pk.raw, "sk": c.sk.raw, "shards": c.shards, "values": {v.name: [v.sum, str(v.where)] for v in c.values}} for c in e.counters},
    }


def fingerprint(x: Any) -> str:
    """Eight bytes of SHA-256, in hex, whatever the order of keys."""
    return hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def shape_rows(s: dict[str, Any]) -> list[tuple[str, str, str]]:
    """part, name and definition of a shape, flat."""
    out = [("key", k, s[k]) for k in ("pk", "sk")] + [("ttl", "ttl", s["ttl"])]
    for part in ("fields", "indexes", "uniques"):
        out += [(part, n, json.dumps(d, sort_keys=True)) for n, d in s[part].items()]
    for n, c in s["counters"].items():
        out += [("counters", f"{n}.{v}", json.dumps([c["pk"], c["sk"], c["shards"], d])) for v, d in c["values"].items()]
    return out


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """part, name, change, compatible: by name over both shapes' rows (part, name, definition).

    Compatible is what stored items survive, with versions before and after it at work side by side: a new field that may be
    missing, one that is gone or may be missing now, an enum with more values. Everything else needs a new generation:
    keys, expiry, another type or attribute, a field that must be there now, and any derived item that comes, changes or
    goes, since items have none of it or one version stops keeping it up."""
    both = old.withColumnRenamed("definition", "was").join(new.withColumnRenamed("definition", "now"), ["part", "name"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    of = lambda side, name: F.get_json_object(side, f"$.{name}")
    must = F.coalesce(of("now", "required") == "true", F.lit(False))
    lost = F.size(F.array_except(F.from_json(of("was", "values"), "array<string>"), F.from_json(of("now", "values"), "array<string>"))) > 0
    kept = (of("was", "type") == of("now", "type")) & of("was", "attr").eqNullSafe(of("now", "attr"))
    stays = kept & ~lost & (~must | (of("was", "required") == "true"))
    fits = (F.col("part") == "fields") & F.when(F.col("change") == "added", ~must).when(F.col("change") == "changed", stays).otherwise(F.lit(True))
    return both.withColumn("change", change).filter("change is not null").select("part", "name", "change", fits.alias("compatible"))


def compatible(part: str, was: str | None, now: str | None) -> bool:
    """As `classify` judges a change from one definition to another; None is none."""
    if part != "fields":
        return False
    if now is None:
        return True
    b = json.loads(now)
    if was is None:
        return not b["required"]
    a = json.loads(was)
    return a["type"] == b["type"] and a.get("attr") == b.get("attr") and (a["required"] or not b["required"]) and set(a["values"]) <= set(b["values"])


def reused_attributes(history: DataFrame) -> DataFrame:
    """Attributes that one generation used with several types: entity, generation, version, attribute, type."""
    later = history.select("entity", "generation", "attribute", F.col("type").alias("type_b"), F.col("version").alias("version_b"))
    return history.join(later, ["entity", "generation", "attribute"]).filter("version < version_b and type <> type_b").select("entity", "generation", "attribute", "version", "version_b", "type", "type_b")


def attribute_history(versions: list[dict[str, Any]], generations: list[int]) -> list[tuple[str, int, int, str, str]]:
    """entity, generation, version, attribute and type of every field of an entity's shapes, for `reused_attributes`."""
    return [(s["entity"], g, s["version"], f["attr"], f["type"]) for s, g in zip(versions, generations, strict=True) for f in s["fields"].values()]


def next_version(locked: dict[str, Any] | None, e: Entity) -> tuple[str, list[str]]:
    """unchanged, new_version or new_generation, with what has to be done about it."""
    now = shape(e)
    if locked is None:
        return "new_version", [f"{e.name} is new"]
    if fingerprint({**locked, "version": 0}) == fingerprint({**now, "version": 0}):
        return "unchanged", []
    notes = []
    old, new = ({(p, n): d for p, n, d in shape_rows(s)} for s in (locked, now))
    for k in sorted(old.keys() | new.keys()):
        if old.get(k) == new.get(k):
            continue
        kind = "added" if k not in old else "removed" if k not in new else "changed"
        notes.append(f"{k[0]} {k[1]} {kind}" + ("" if compatible(k[0], old.get(k), new.get(k)) else ": needs a new generation"))
    state = needed(old, new)
    if state == "new_version" and e.version <= locked["version"]:
        notes.append(f"raise the version above {locked['version']}")
    return state, notes


def needed(old: dict[tuple[str, str], str], new: dict[tuple[str, str], str]) -> str:
    """new_generation if stored items don't survive some change between two shapes' rows, else new_version."""
    differ = (k for k in old.keys() | new.keys() if old.get(k) != new.get(k))
    return "new_version" if all(compatible(k[0], old.get(k), new.get(k)) for k in differ) else "new_generation"


def conversion_gaps(old: Entity, new: Entity) -> list[str]:
    """Fields that a copy can't fill by itself: required and new, or of another type (a list may become a set)."""
    had = {f.name: f for f in old.fields}
    out = []
    for f in new.fields:
        if f.name not in had:
            if f.required or f.name in new.key_fields:
                out.append(f.name)
        elif had[f.name].type != f.type and (had[f.name].type, f.type) != ("string_list", "string_set"):
            out.append(f.name)
    return out


def diff(old: DataFrame, new: DataFrame, key: list[str], measures: list[str], texts: list[str]) -> DataFrame:
    """Rows of two designs by key: added, removed or changed. A measure counts as changed beyond a tenth of what it was."""
    a = old.select(*key, *(F.col(c).alias(f"old_{c}") for c in measures + texts), F.lit(True).alias("_a"))
    b = new.select(*key, *(F.col(c).alias(f"new_{c}") for c in measures + texts), F.lit(True).alias("_b"))
    both = a.join(b, key, "full")
    moved = F.lit(False)
    for c in texts:
        moved = moved | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    for c in measures:
        was, now = F.col(f"old_{c}"), F.col(f"new_{c}")
        moved = moved | F.when(was.isNull() | now.isNull(), ~was.eqNullSafe(now)).otherwise(F.abs(now - was) > F.abs(was) * SIGNIFICANT)
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(moved, "changed")
    return both.withColumn("change", change).filter("change is not null").drop("_a", "_b")


def finding_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings by rule, subject and how many of the same came before: new, resolved, accepted, unaccepted or of other severity."""
    w = Window.partitionBy("rule", "subject").orderBy("severity", "accepted")
    number = lambda df: df.withColumn("nth", F.row_number().over(w))
    a = number(old).select("rule", "subject", "nth", F.col("severity").alias("was"), F.col("accepted").alias("was_accepted"))
    b = number(new).select("rule", "subject", "nth", F.col("severity").alias("now"), F.col("accepted").alias("now_accepted"))
    both = a.join(b, ["rule", "subject", "nth"], "full")
    change = (
        F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "resolved").when(F.col("was") != F.col("now"), "severity").when(~F.col("was_accepted") & F.col("now_accepted"), "accepted").when(F.col("was_accepted") & ~F.col("now_accepted"), "unaccepted")
    )
    return both.withColumn("change", change).filter("change is not null").select("rule", "subject", "nth", "change")


def migration_cost(items: float, own_wru: float, async_wru: float, rru: float) -> dict[str, float]:
    """Read units of a pass, and write units of the copy: every write is a transaction with a fence."""
    return {"items": items, "rru": items * rru, "wru": items * (2 * (own_wru + 1) + async_wru)}


# --- copying ----------------------------------------------------------------------------------------------------------

Convert = Callable[[DataFrame], DataFrame]


def converted(source: DataFrame, old: Entity, new: Entity, convert: Convert | None = None) -> DataFrame:
    """The source's rows in the new fields, with where they come from (src_pk, src_sk, src_rev). Lists become sets."""
    pk, sk = item_key(old)
    rows = source.withColumns({"src_pk": pk, "src_sk": sk})
    if "_rev" not in source.columns:
        rows = rows.withColumn("_rev", F.lit(1).cast("bigint"))
    rows = rows.withColumnRenamed("_rev", "src_rev")
    had = {f.name: f.type for f in old.fields}
    for f in new.fields:
        if had.get(f.name) == "string_list" and f.type == "string_set":
            rows = rows.withColumn(f.name, F.array_distinct(f.name))
    return convert(rows) if convert else rows


def to_copy(rows: DataFrame, copied: DataFrame) -> DataFrame:
    """Rows that the target doesn't have at their revision."""
    return rows.join(copied.select("src_pk", "src_sk", "src_rev"), ["src_pk", "src_sk", "src_rev"], "left_anti")


def stale(copied: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Copies whose source is gone or now has another key."""
    return copied.join(rows.select("src_pk", "src_sk", *key), ["src_pk", "src_sk", *key], "left_anti")


def conflicts(rows: DataFrame, e: Entity) -> DataFrame:
    """Rows that can't be copied, with why: several sources render to one key, a required field is empty, or the key is too
    long. Counted before the rows are joined back, so a key with many sources isn't gathered anywhere."""
    keys = e.key_fields
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    both = rows.join(many, keys, "left")
    pk, sk = item_key(e)
    why = F.when(missing_required(e), "required").when(~lengths_ok(pk, sk), "key_too_long").when(F.col("_n").isNotNull(), "same_key")
    return both.withColumn("conflict", why).filter("conflict is not null").drop("_n")


def conflict_key(pk: str, sk: str) -> str:
    """The record of a conflict: its length-prefixed key, hashed where it would be too long."""
    text = f"{len(pk)}#{pk}{sk}"
    return text if len(text.encode()) <= MAX_SK else hashlib.sha256(text.encode()).hexdigest()


def report(source: DataFrame, copied: DataFrame) -> DataFrame:
    """One row: how many of the source's rows are copied at their revision (same) and how many are still to be (copied)."""
    there = copied.select("src_pk", "src_sk", "src_rev").distinct().withColumn("_x", F.lit(True))
    both = source.join(there, ["src_pk", "src_sk", "src_rev"], "left")
    return both.agg(F.count_if(F.col("_x").isNull()).alias("copied"), F.count_if(F.col("_x").isNotNull()).alias("same"))


def with_copies(source: DataFrame, copied: DataFrame) -> DataFrame:
    """The source's rows with `has_copy`, by where copies say that they come from."""
    there = copied.select("src_pk", "src_sk").distinct().withColumn("_x", F.lit(True))
    return source.join(there, ["src_pk", "src_sk"], "left").withColumn("has_copy", F.col("_x").isNotNull()).drop("_x")


def catch_up(read_source: Callable[[], DataFrame], copied: DataFrame, old: Entity, new: Entity, save: Callable[[DataFrame], DataFrame], convert: Convert | None = None, max_passes: int = 3) -> tuple[DataFrame, list[dict[str, int]]]:
    """A bulk pass and at most max_passes more, until one changes nothing. save stores the target and returns it as stored."""
    report = []
    for _ in range(1 + max_passes):
        rows = converted(read_source(), old, new, convert)
        bad = conflicts(rows, new).select("src_pk", "src_sk")
        good = rows.join(bad, ["src_pk", "src_sk"], "left_anti")
        fresh = to_copy(good, copied)
        gone = stale(copied, rows, new.key_fields)
        changed = {"copied": fresh.count(), "removed": gone.count(), "conflicts": bad.count()}
        changed["same"] = good.count() - changed["copied"]
        report.append(changed)
        if not changed["copied"] and not changed["removed"]:
            break
        replaced = fresh.select("src_pk", "src_sk")
        kept = copied.join(gone.select("src_pk", "src_sk").unionByName(replaced), ["src_pk", "src_sk"], "left_anti")
        copied = save(kept.unionByName(fresh.select(*copied.columns)))
    return copied, report


def pass_cost(e: Entity, n: float) -> dict[str, float]:
    size = cost.item_size(e)[0]
    return migration_cost(n, cost.write_units(size), 0.0, cost.read_units(size))
