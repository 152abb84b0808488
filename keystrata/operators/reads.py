"""Declared reads: point, batch, unique, range, paged, partition and counter reads as DataFrame plans."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions.keys import bounds, fields_equal, item_key, literal, lowered, lowered_elements, lowered_value, present, render
from keystrata.functions.preds import holds, live
from keystrata.model import Access, Entity


def items(rows: DataFrame, e: Entity) -> DataFrame:
    """The entity's rows as items of the table: rendered key and type beside the fields, under their attributes' names."""
    pk, sk = item_key(e)
    return rows.select(pk, sk, F.lit(e.name).alias("_t"), *(F.col(f.name).alias(f.attribute) for f in e.fields))


def fields_of(items_: DataFrame, e: Entity) -> DataFrame:
    """The entity's own items with their fields under the fields' names; attributes that it doesn't know are left out."""
    return items_.filter(F.col("_t") == e.name).select(*(F.col(f.attribute).alias(f.name) for f in e.fields))


def get(rows: DataFrame, e: Entity, key: dict[str, Any], now: int | None = None) -> DataFrame:
    """At most one row. The condition is on native fields, so the scan can skip files and row groups."""
    out = rows.filter(fields_equal(e, key))
    return out if now is None else out.filter(live(e.ttl, F.lit(now)))


def batch_get(rows: DataFrame, e: Entity, keys: DataFrame) -> DataFrame:
    """Rows that exist for the keys asked for, in the order in which each was first asked for. keys: key fields and pos.

    The asked keys are the small side by nature; the optimiser broadcasts them only if their size shows it."""
    asked = keys.groupBy(*e.key_fields).agg(F.min("pos").alias("pos"))
    return rows.join(asked, e.key_fields).orderBy("pos")


def unique_lookup(rows: DataFrame, claims: DataFrame, e: Entity, name: str, values: dict[str, Any]) -> DataFrame:
    """The owner of a unique value: the claim, its owner, and a second look that the owner still holds the value."""
    u = e.unique(name)
    wanted = claims.filter(fields_equal(e, {k: v for k, v in values.items() if k != u.element}))
    still = F.lit(True)
    if u.element:
        wanted = wanted.filter(F.col("_element") == values[u.element])
        still = F.array_contains(u.element, values[u.element])
    owners = wanted.select(*e.key_fields).distinct()
    held = rows.join(owners, e.key_fields, "left_semi")
    return held.filter(still & fields_equal(e, {k: v for k, v in values.items() if k != u.element}))


def query(rows: DataFrame, e: Entity, access: Access, partition: dict[str, Any], low: Any = None, high: Any = None, size: int | None = None, after: dict[str, Any] | None = None, now: int | None = None) -> DataFrame:
    """One page of a partition in sort-key order, of the entity itself, a GSI or a copy.

    Bounds and the place to go on from are conditions on native fields; the sort is a top-k of the page. An expired row
    still takes its place in the page: liveness is looked at after the limit."""
    ix = None if access.target == "key" else e.index(access.target)
    sk = e.sk if ix is None else ix.sk
    out = rows if ix is None else index_view(rows, e, access.target)
    cond = fields_equal(e, partition)
    if access.range:
        cond = cond & bounds(e, sk, access.range, low, high)
    order = [n for n in sk.fields if n not in partition] if sk else []
    order += [n for n in e.key_fields if n not in order and n not in partition]
    lower = {p.field for p in sk.parts if p.lower} if sk else set()
    columns = [lowered(F.col(n)) if n in lower else F.col(n) for n in order]
    if after is not None:
        cond = cond & beyond(e, order, lower, after, access.order == "desc")
    limit = min(size or access.page, access.max_page)
    keys = [c.desc() if access.order == "desc" else c.asc() for c in columns]
    out = out.filter(cond).orderBy(*keys).limit(limit)
    if now is not None and e.ttl:
        out = out.filter(live(e.ttl, F.lit(now)))
    if access.project:
        out = out.select(*[f.name for f in e.fields if f.name in set(access.project) | set(e.key_fields)])
    return out


def beyond(e: Entity, order: list[str], lower: set[str], after: dict[str, Any], desc: bool):
    """Rows after a place in an order: (a, b) > (x, y) as a > x or a = x and b > y."""
    cond, same = F.lit(False), F.lit(True)
    for n in order:
        c = lowered(F.col(n)) if n in lower else F.col(n)
        v = literal(lowered_value(after[n]) if n in lower else after[n], e.field(n))
        cond = cond | (same & ((c < v) if desc else (c > v)))
        same = same & (c == v)
    return cond


def index_view(rows: DataFrame, e: Entity, name: str) -> DataFrame:
    """An index's rows: those whose key fields are present and whose condition holds, projected. Set elements give one each."""
    ix = e.index(name)
    sets = [n for n in ix.pk.fields + (ix.sk.fields if ix.sk else []) if e.field(n).type == "string_set"]
    columns = e.projection(ix)
    if sets:
        part = next(p for t in (ix.pk, ix.sk) if t for p in t.parts if p.field == sets[0])
        values = lowered_elements(F.col(sets[0])) if part.lower else F.col(sets[0])
        rows = rows.withColumn("_element", F.explode(F.array_distinct(values)))
        element = (sets[0], F.col("_element"))
        return rows.filter(present(e, ix.pk, ix.sk, element=element) & holds(e, ix.where)).select("_element", *columns)
    return rows.filter(present(e, ix.pk, ix.sk) & holds(e, ix.where)).select(*columns)


def first_pages(rows: DataFrame, e: Entity, per: int, desc: bool = False) -> DataFrame:
    """The first rows of every partition; the group limit runs before the shuffle."""
    own = [n for n in e.key_fields if n not in e.pk.fields]
    order = [F.col(n).desc() if desc else F.col(n).asc() for n in own]
    w = Window.partitionBy(*e.pk.fields).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per)


def partition_read(entities: list[tuple[Entity, DataFrame]], values: dict[str, Any]) -> DataFrame:
    """Everything of one partition, of several entities, told apart by _t."""
    out = None
    for e, rows in entities:
        part = items(rows.filter(fields_equal(e, {k: values[k] for k in e.pk.fields})), e)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def scan(rows: DataFrame, e: Entity, now: int | None = None) -> DataFrame:
    return rows if now is None else rows.filter(live(e.ttl, F.lit(now)))


def scan_page(everything: DataFrame, kind: str, after: tuple[str, str] | None, size: int) -> DataFrame:
    """One page of a scan of the whole table in key order, then its rows of one kind: a page may be empty and yet not the last.

    after: PK and SK of the last row of the page before. Every task hands over its first `size` rows beyond it."""
    rest = everything if after is None else everything.filter((F.col("PK") > after[0]) | ((F.col("PK") == after[0]) & (F.col("SK") > after[1])))
    return rest.orderBy("PK", "SK").limit(size).filter(F.col("_t") == kind)


def page_end(everything: DataFrame, after: tuple[str, str] | None, size: int) -> tuple[str, str] | None:
    """PK and SK of the last row of a page; None if nothing is left."""
    rest = everything if after is None else everything.filter((F.col("PK") > after[0]) | ((F.col("PK") == after[0]) & (F.col("SK") > after[1])))
    end = rest.select("PK", "SK").orderBy("PK", "SK").limit(size).agg(F.max(F.struct("PK", "SK")).alias("k")).first()["k"]
    return None if end is None else (end["PK"], end["SK"])


def segment_of(pk: Column, segments: int) -> Column:
    """The segment of a scan that an item belongs to, by its partition key's digest."""
    return (F.conv(F.substring(F.sha2(pk, 256), 1, 8), 16, 10).cast("bigint") % segments).cast("int")


def scan_segments(rows: DataFrame, e: Entity, segments: int, done: tuple[int, ...] = ()) -> DataFrame:
    """The rows with their segment, but for segments that an earlier run has finished."""
    out = rows.withColumn("segment", segment_of(render(e.pk, e), segments))
    return out.filter(~F.col("segment").isin(list(done))) if done else out


def get_many(rows: DataFrame, e: Entity, keys: DataFrame) -> DataFrame:
    """Items that exist of the keys asked for, once each, in no order."""
    return rows.join(keys.select(*e.key_fields), e.key_fields, "left_semi")


def scope(design: str, access: Access, partition: dict[str, Any], low: Any = None, high: Any = None) -> str:
    text = json.dumps([design, access.name, access.target, sorted(partition.items()), str(low), str(high)], default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


class CursorError(ValueError):
    pass


def encode_cursor(scope_: str, last: dict[str, Any], key: bytes | None = None) -> str:
    body = json.dumps({"s": scope_, "k": last}, separators=(",", ":"), sort_keys=True, default=str).encode()
    sign = hmac.new(key, body, hashlib.sha256).digest() if key else b""
    return base64.urlsafe_b64encode(sign + body).decode().rstrip("=")


def decode_cursor(text: str, scope_: str, keys: tuple[bytes, ...] = ()) -> dict[str, Any]:
    """The place to go on from. With keys, one of them must have signed the cursor; older keys may stay in the list."""
    try:
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
    except ValueError as err:
        raise CursorError("the cursor can't be read") from err
    if keys:
        sign, raw = raw[:32], raw[32:]
        if not any(hmac.compare_digest(hmac.new(k, raw, hashlib.sha256).digest(), sign) for k in keys):
            raise CursorError("the cursor isn't signed by a known key")
    try:
        body = json.loads(raw)
    except ValueError as err:
        raise CursorError("the cursor can't be read") from err
    if not isinstance(body, dict) or body.get("s") != scope_:
        raise CursorError("the cursor belongs to another read")
    return body["k"]


def counter_read(counters: DataFrame, key: dict[str, Any], values: list[str], spark: SparkSession) -> DataFrame:
    """One row, of zeros where the counter doesn't exist."""
    asked = spark.createDataFrame([tuple(key.values())], list(key))
    found = asked.join(counters, list(key), "left")
    return found.select(*key, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def render_all(rows: DataFrame, e: Entity, name: str) -> DataFrame:
    """An index's entries with their rendered keys."""
    ix = e.index(name)
    keyed = [render(ix.pk, e).alias("index_pk")] + ([render(ix.sk, e).alias("index_sk")] if ix.sk else [])
    return rows.filter(present(e, ix.pk, ix.sk) & holds(e, ix.where)).select(*keyed, *e.projection(ix))
