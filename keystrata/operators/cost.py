"""Sizes, capacity units and money of a design: from declared assumptions on the driver, and measured on rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrata.functions.keys import item_key, render
from keystrata.model import Access, Counter, Design, Entity, Field, Index, Template, Write

# Sizes in bytes, units, prices in dollars and limits of the store.
STAMPS = (2 * 30 + len("_created") + len("_updated"),) * 2
CLAIM = (230, 230)
OVERHEAD = 100
WRITE_UNIT, READ_UNIT = 1024, 4096
SECONDS_PER_MONTH = 2_592_000
PRICE_WRITE, PRICE_READ, PRICE_GB = 0.625, 0.125, 0.25
PARTITION_WRITES, PARTITION_READS = 1000, 3000
ELEMENT = 20
# End of fixed values.

Size = tuple[int, int]


def add(*sizes: Size) -> Size:
    return sum(s[0] for s in sizes), sum(s[1] for s in sizes)


def attribute(name: str, value: Size) -> Size:
    return len(name) + value[0], len(name) + value[1]


def key_size(t: Template, e: Entity) -> Size:
    widths = {"string_set": (ELEMENT, ELEMENT), "time": (30, 30), "int": (19, 20), "bool": (5, 5)}
    return add((0, 0), *((len(p.literal),) * 2 if not p.field else widths.get(e.field(p.field).type, e.field(p.field).sizes) for p in t.parts))


def meta_size(e: Entity) -> Size:
    return add(attribute("_t", (len(e.name),) * 2), attribute("_v", (2, 2)))


def index_keys(ix: Index, e: Entity) -> Size:
    pk = attribute(f"{ix.name}PK", key_size(ix.pk, e))
    return add(pk, attribute(f"{ix.name}SK", key_size(ix.sk, e))) if ix.sk else pk


def own_keys(e: Entity) -> Size:
    return add(attribute("PK", key_size(e.pk, e)), attribute("SK", key_size(e.sk, e)))


def fields_size(fields: list[Field]) -> Size:
    return add((0, 0), *(attribute(f.attribute, f.sizes) for f in fields))


def item_size(e: Entity) -> Size:
    gsis = [index_keys(i, e) for i in e.indexes if i.strategy == "gsi"]
    return add(own_keys(e), meta_size(e), attribute("_rev", (3, 5)), STAMPS, fields_size(list(e.fields)), *gsis, *([attribute("ttl", (6, 6))] if e.ttl else []))


def entry_size(ix: Index, e: Entity) -> Size:
    """An index's entry or copy: its keys, the item's, and the projected fields."""
    fields = [e.field(n) for n in e.projection(ix)]
    if ix.strategy == "copy":
        keys = add(attribute("PK", key_size(ix.pk, e)), attribute("SK", key_size(ix.sk, e)))
        return add(keys, meta_size(e), STAMPS, fields_size(fields))
    return add(own_keys(e), index_keys(ix, e), meta_size(e), fields_size(fields))


def counter_size(c: Counter, e: Entity) -> Size:
    keys = add(attribute("PK", key_size(c.pk, e)), attribute("SK", key_size(c.sk, e)), attribute("_t", (len(c.name),) * 2), STAMPS)
    return add(keys, *(attribute(v.name, (8, 11)) for v in c.values))


def elements(f: Field) -> Size:
    return tuple(max(1, -(-s // ELEMENT)) for s in f.sizes)


def write_units(size: float) -> int:
    return max(1, math.ceil(size / WRITE_UNIT))


def read_units(size: float, consistent: bool = False) -> float:
    return max(1, math.ceil(size / READ_UNIT)) * (1.0 if consistent else 0.5)


def read_cost(e: Entity, a: Access) -> tuple[float, float]:
    """Read units, p50 and p99. A lookup by a unique value reads the claim too; a page reads its rows together."""
    factor = a.freshness == "immediate"
    size = item_size(e)
    if a.kind == "query" and a.target != "key":
        size = entry_size(e.index(a.target), e)
    if a.kind in ("query", "scan", "partition"):
        return tuple(read_units(s * a.page, factor) for s in size)
    if a.kind == "unique":
        return tuple(1 + read_units(s, True) for s in size)
    if a.kind in ("counter", "counter_all"):
        c = next((c for c in e.counters if c.name == a.target), None)
        n = c.shards if c else 1
        return tuple(n * read_units(s, factor) for s in (counter_size(c, e) if c else (0, 0)))
    return tuple(read_units(s, factor) for s in size)


@dataclass(frozen=True)
class Touch:
    """A kind of item that a write puts, changes or checks."""

    kind: str
    name: str
    size: Size
    count: float = 1
    asynchronous: bool = False


def touches(design: Design, e: Entity, w: Write) -> list[Touch]:
    out = [Touch("item", e.name, item_size(e))]
    changed = None if w.kind in ("create", "delete") else {*w.fields, *dict(w.set), *dict(w.add_to), *dict(w.remove_from)}
    hit = lambda names: changed is None or bool(changed & set(names))
    for ix in e.indexes:
        inputs = [*ix.pk.fields, *(ix.sk.fields if ix.sk else ()), *(p.field for p in ix.where)]
        moves = 2 if changed is not None and hit(inputs) else 1
        if hit([*inputs, *e.projection(ix)]):
            out.append(Touch("gsi" if ix.strategy == "gsi" else "copy", ix.name, entry_size(ix, e), moves, ix.strategy == "gsi"))
    for u in e.uniques:
        if hit(u.fields):
            n = elements(e.field(u.element))[0] if u.element else 1
            out.append(Touch("claim", u.name, CLAIM, n * (2 if changed is not None else 1)))
    for c in e.counters:
        inputs = {*c.pk.fields, *c.sk.fields, *(p.field for v in c.values for p in v.where), *(v.sum for v in c.values if v.sum)}
        if hit(inputs):
            out.append(Touch("counter", c.name, counter_size(c, e)))
    for r in w.requires:
        t = design.entity(r.entity)
        out.append(Touch("item" if r.set or r.add or r.patch or r.consume or r.ensure else "check", t.name, item_size(t)))
    return out


def write_cost(design: Design, e: Entity, w: Write) -> tuple[float, float, int]:
    """Write units, p50 and p99, and items of the transaction. A transaction doubles what isn't asynchronous."""
    found = touches(design, e, w)
    items = round(sum(t.count for t in found if not t.asynchronous))
    factor = 2 if items > 1 else 1
    both = [sum(write_units(t.size[k]) * t.count * (1 if t.asynchronous else factor) for t in found) for k in (0, 1)]
    n = w.batch or 1
    return both[0] * n, both[1] * n, items


def monthly(units: float, rate: float, price: float) -> float:
    return units * rate * SECONDS_PER_MONTH / 1e6 * price


def entity_month(design: Design, e: Entity) -> float:
    reads = sum(monthly(read_cost(e, a)[0], a.rate, PRICE_READ) for a in e.access)
    return reads + sum(monthly(write_cost(design, e, w)[0], w.rate, PRICE_WRITE) for w in e.writes)


def storage_bytes(e: Entity, count: float) -> float:
    total = count * (item_size(e)[0] + OVERHEAD)
    for ix in e.indexes:
        total += count * ix.matches * (entry_size(ix, e)[0] + OVERHEAD)
    for u in e.uniques:
        total += count * (elements(e.field(u.element))[0] if u.element else 1) * (CLAIM[0] + OVERHEAD)
    return total


def counts(design: Design) -> dict[str, float | None]:
    """Items of each entity: a total, or its parent's times the typical number; None where nothing is declared."""
    out: dict[str, float | None] = {}

    def of(name: str) -> float | None:
        if name not in out:
            v = design.entity(name).volume
            out[name] = v.total
            if v.total is None and v.per and v.typical is not None and (parent := of(v.per)) is not None:
                out[name] = parent * v.typical
        return out[name]

    for e in design.entities:
        of(e.name)
    return out


# --- measured ---------------------------------------------------------------------------------------------------------


def observed_width(f: Field) -> Column:
    """Bytes of a field's value in a row; a missing value takes none."""
    c = F.col(f.name)
    if f.type in ("string", "enum", "bytes"):
        n = F.octet_length(c)
    elif f.type in ("int", "float"):
        n = F.octet_length(c.cast("string"))
    elif f.type == "bool":
        n = F.lit(1)
    elif f.type == "time":
        n = F.lit(30)
    elif f.type in ("string_list", "string_set"):
        n = F.aggregate(c, F.lit(0), lambda a, x: a + F.octet_length(x))
    else:
        n = F.aggregate(F.map_entries(c), F.lit(0), lambda a, x: a + F.octet_length(x["key"]) + F.octet_length(x["value"]))
    return F.when(c.isNotNull(), n + len(f.name)).otherwise(0)


def observed_item_size(e: Entity) -> Column:
    """Bytes of the stored item: keys, type, version, revision, stamps and the fields that hold something."""
    pk, sk = item_key(e)
    total = F.lit(4) + F.octet_length(pk) + F.octet_length(sk) + F.lit(meta_size(e)[0] + attribute("_rev", (3, 5))[0] + STAMPS[0])
    for f in e.fields:
        total = total + observed_width(f)
    for ix in e.indexes:
        if ix.strategy == "gsi":
            total = total + F.lit(len(ix.name) * (2 if ix.sk else 1) + (4 if ix.sk else 2)) + F.octet_length(render(ix.pk, e)) + (F.octet_length(render(ix.sk, e)) if ix.sk else F.lit(0))
    return total.cast("bigint")


def observed_write_units(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / float(WRITE_UNIT))).cast("bigint")


def observed_read_units(size: Column, consistent: bool = False) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / float(READ_UNIT))) * (1.0 if consistent else 0.5)


def size_summary(rows: DataFrame, e: Entity) -> DataFrame:
    size = observed_item_size(e)
    return rows.select(size.alias("b")).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.percentile("b", F.lit(0.5)).alias("p50"),
        F.percentile("b", F.lit(0.99)).alias("p99"),
        F.sum("b").cast("bigint").alias("bytes"),
        F.sum(observed_write_units(F.col("b"))).cast("bigint").alias("wru"),
        F.sum(observed_read_units(F.col("b"))).alias("rru"),
    )


def pages_to_read(n: Column, page: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / float(page))).cast("bigint")


def scan_units(size: Column, consistent: bool = False) -> Column:
    return F.ceil(size / float(READ_UNIT)) * (1.0 if consistent else 0.5)


def estimated_elements(size: Column) -> Column:
    """How many elements a set of so many bytes is taken to have."""
    return F.greatest(F.lit(1), F.ceil(size / float(ELEMENT))).cast("bigint")


def held_elements(name: str) -> Column:
    return F.size(F.array_distinct(name)).cast("bigint")


def capped_read_units(units: Column, held: Column, item_bytes: int) -> Column:
    """Units of a read that can't cost more than reading all that its partition holds."""
    return F.least(units, observed_read_units(held * item_bytes))
