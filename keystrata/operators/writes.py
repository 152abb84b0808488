"""Declared writes as set-based checks of commands against a snapshot: an outcome for each command, then the new rows.

Commands are frames. A command that fails changes nothing; its outcome names the first reason in the order in which a single
write would have found it: not found, version, precondition, requirement, limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from keystrata.functions.keys import literal, separators_ok
from keystrata.functions.preds import holds, live
from keystrata.model import Entity, Require, Write
from keystrata.operators.derive import counter_delta

# Outcomes, and retry and transaction limits.
OK, EXISTS, NOT_FOUND, VERSION, PRECONDITION, REQUIREMENT, LIMIT, MINIMUM, INVALID, DUPLICATE, UNCHANGED = (
    "ok", "exists", "not_found", "version_mismatch", "precondition", "requirement", "limit", "minimum", "invalid", "duplicate", "unchanged",
)
MAX_OPERATIONS = 100
RETRIES, FIRST_WAIT, LONGEST_WAIT = 8, 0.005, 0.25
# End of fixed values.


def _first(*cases: tuple[Column, str]) -> Column:
    out = None
    for cond, name in cases:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(OK)


def missing_required(e: Entity) -> Column:
    cond = F.lit(False)
    for f in e.fields:
        if f.required:
            c = F.col(f.name)
            cond = cond | c.isNull() | ((c == literal(f.zero, f)) if f.zero is not None else F.lit(False))
    return cond


def duplicates(commands: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The commands with `first`: whether no earlier one touches the same item."""
    w = Window.partitionBy(*keys).orderBy(order)
    return commands.withColumn("first", F.row_number().over(w) == 1)


def create(commands: DataFrame, snapshot: DataFrame, e: Entity, w: Write, now: int | None = None, order: str = "seq") -> DataFrame:
    """The commands with their outcome. Constants of the write replace what the caller gives. An expired row is no obstacle;
    of commands for one key the first wins. A command whose _rev the stored row already has was applied before: it is ok."""
    for name, v in w.set:
        commands = commands.withColumn(name, literal(v, e.field(name)))
    there = snapshot.filter(live(e.ttl, F.lit(now))) if now is not None else snapshot
    again = "_rev" in commands.columns and "_rev" in there.columns
    there = there.groupBy(*e.key_fields).agg((F.max("_rev") if again else F.lit(0)).alias("_stored"))
    tried = duplicates(commands, e.key_fields, order).join(there, e.key_fields, "left")
    bad = missing_required(e) | ~separators_ok(e)
    taken = F.col("_stored").isNotNull() & (~F.col("_stored").eqNullSafe(F.col("_rev")) if again else F.lit(True))
    return tried.withColumn("outcome", _first((bad, INVALID), (taken, EXISTS), (~F.col("first"), EXISTS))).drop("_stored", "first")


def guarded(commands: DataFrame, snapshot: DataFrame, e: Entity, w: Write, now: int | None = None) -> DataFrame:
    """Commands joined to their stored rows (columns old_*), with an outcome: it must exist, be live, have the expected
    revision (command column expect_rev, if there is one) and meet the write's conditions."""
    old = snapshot.select(*e.key_fields, *(F.col(c).alias(f"old_{c}") for c in snapshot.columns if c not in e.key_fields), F.lit(True).alias("_there"))
    both = commands.join(old, e.key_fields, "left")
    gone = F.col("_there").isNull()
    if now is not None and e.ttl:
        gone = gone | ~live(f"old_{e.ttl}", F.lit(now))
    cases = [(gone, NOT_FOUND)]
    if "expect_rev" in commands.columns and "_rev" in snapshot.columns:
        cases.append((F.col("expect_rev").isNotNull() & ~F.col("expect_rev").eqNullSafe(F.col("old__rev")), VERSION))
    if w.when:
        renamed = both
        cond = _stored(e, w)
        cases.append((~cond, PRECONDITION))
        both = renamed
    return both.withColumn("outcome", _first(*cases)).drop("_there")


def _stored(e: Entity, w: Write) -> Column:
    """The write's conditions over the old_ columns."""
    cond = F.lit(True)
    for p in w.when:
        f = e.field(p.field)
        c = F.col(f"old_{p.field}" if p.field not in e.key_fields else p.field)
        c = c if f.zero is None else F.coalesce(c, literal(f.zero, f))
        hit = F.coalesce(c.isin(list(p.values)), F.lit(False)) if len(p.values) > 1 else c.eqNullSafe(literal(p.values[0], f))
        cond = cond & (~hit if p.negate else hit)
    return cond


def new_values(e: Entity, w: Write) -> dict[str, Column]:
    """What each changed field becomes: given, set to a constant, patched if given (a has_ flag tells), or a set's elements."""
    out: dict[str, Column] = {}
    for name in w.fields:
        out[name] = F.when(F.col(f"has_{name}"), F.col(name)).otherwise(F.col(f"old_{name}")) if w.kind == "patch" else F.col(name)
    for name, v in w.set:
        out[name] = literal(v, e.field(name))
    nothing = F.array().cast("array<string>")
    for name, how in (*w.add_to, *w.remove_from):
        given = F.col(f"arg_{name}") if how == "arg" else F.array(F.lit(how))
        given = F.filter(F.coalesce(given, nothing), lambda x: x != "")
        old = F.coalesce(out.get(name, F.col(f"old_{name}")), nothing)
        out[name] = F.array_union(old, given) if (name, how) in w.add_to else F.array_except(old, given)
    return out


def update(commands: DataFrame, snapshot: DataFrame, e: Entity, w: Write, now: int | None = None) -> DataFrame:
    """Commands with outcome and the row's new values in new_* columns. A write that would change nothing is `unchanged`."""
    both = guarded(commands, snapshot, e, w, now)
    changed = new_values(e, w)
    differs = F.lit(False)
    for name, c in changed.items():
        differs = differs | ~c.eqNullSafe(F.col(f"old_{name}"))
    both = both.withColumns({f"new_{n}": F.when(F.col("outcome") == OK, c).otherwise(F.col(f"old_{n}")) for n, c in changed.items()})
    return both.withColumn("outcome", F.when((F.col("outcome") == OK) & ~differs, UNCHANGED).otherwise(F.col("outcome")))


def apply_update(snapshot: DataFrame, done: DataFrame, e: Entity, w: Write) -> DataFrame:
    """The snapshot with the accepted updates in it."""
    names = [c.removeprefix("new_") for c in done.columns if c.startswith("new_")]
    ok = done.filter(F.col("outcome") == OK).select(*e.key_fields, *(f"new_{n}" for n in names), F.lit(True).alias("_hit"))
    both = snapshot.join(ok, e.key_fields, "left")
    cols = [F.when(F.col("_hit").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.when(F.col("_hit").isNotNull(), F.col(c) + 1).otherwise(F.col(c)).alias(c) if c == "_rev" else F.col(c) for c in snapshot.columns]
    return both.select(*cols)


def delete(commands: DataFrame, snapshot: DataFrame, e: Entity, w: Write, now: int | None = None) -> DataFrame:
    return guarded(commands, snapshot, e, w, now)


def after_delete(snapshot: DataFrame, done: DataFrame, e: Entity) -> DataFrame:
    return snapshot.join(done.filter(F.col("outcome") == OK).select(*e.key_fields), e.key_fields, "left_anti")


def requirement(commands: DataFrame, target: DataFrame, e: Entity, r: Require) -> DataFrame:
    """The commands with `met`: the row that the requirement names exists and satisfies it; if optional, absence will do.

    Commands whose key for it is empty meet an optional requirement and fail another."""
    mapping = dict(r.key)
    aside = target.select(*(F.col(c).alias(f"target_{c}") for c in target.columns), F.lit(True).alias("_there"))
    on = F.lit(True)
    empty = F.lit(False)
    for theirs, ours in mapping.items():
        on = on & (F.col(f"target_{theirs}") == F.col(ours))
        empty = empty | F.col(ours).isNull() | ((F.col(ours) == "") if e.field(theirs).type in ("string", "enum") else F.lit(False))
    both = commands.join(aside, on, "left")
    cond = F.lit(True)
    for p in r.when:
        f = e.field(p.field)
        c = F.col(f"target_{p.field}")
        c = c if f.zero is None else F.coalesce(c, literal(f.zero, f))
        if p.source:
            hit = c.eqNullSafe(F.col(p.source))
        else:
            hit = F.coalesce(c.isin(list(p.values)), F.lit(False)) if len(p.values) > 1 else c.eqNullSafe(literal(p.values[0], f))
        cond = cond & (~hit if p.negate else hit)
    there = F.col("_there").isNotNull()
    met = F.when(empty, F.lit(r.optional)).when(~there, F.lit(r.optional or r.ensure)).otherwise(cond)
    return both.withColumn("met", met).drop("_there")


def changes_on_target(accepted: DataFrame, target: DataFrame, e: Entity, r: Require) -> DataFrame:
    """The target's rows after the accepted commands: constants set, amounts added up, values patched; ensured rows are made."""
    mapping = dict(r.key)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for name, v in r.add:
        amount = F.lit(v) if not isinstance(v, str) else F.coalesce(F.col(v), F.lit(0))
        aggs.append(F.sum(amount).cast("bigint").alias(f"_add_{name}"))
    for name, v in r.patch:
        f = e.field(name)
        given = F.when(F.col(v) != literal(f.zero, f), F.col(v)) if f.zero is not None else F.col(v)
        aggs.append(F.max_by(given, F.when(given.isNotNull(), F.col("seq"))).alias(f"_patch_{name}"))
    hits = accepted.groupBy(*(F.col(ours).alias(theirs) for theirs, ours in mapping.items())).agg(*aggs)
    both = target.join(hits, list(mapping), "full" if r.ensure else "left")
    hit = F.col("_n").isNotNull()
    out = []
    for c in target.columns:
        x = F.col(c)
        if c in dict(r.set):
            x = F.when(hit, literal(dict(r.set)[c], e.field(c))).otherwise(x)
        elif c in dict(r.add):
            x = F.when(hit, F.coalesce(x, F.lit(0)) + F.col(f"_add_{c}")).otherwise(x)
        elif c in dict(r.patch):
            x = F.when(hit, F.coalesce(F.col(f"_patch_{c}"), x)).otherwise(x)
        out.append(x.alias(c))
    return both.select(*out)


def consume(accepted: DataFrame, target: DataFrame, r: Require) -> DataFrame:
    keys = accepted.select(*(F.col(ours).alias(theirs) for theirs, ours in r.key)).distinct()
    return target.join(keys, [t for t, _ in r.key], "left_anti")


def counter_requirement(commands: DataFrame, counters: DataFrame, on: list[str], values: dict[str, int]) -> DataFrame:
    """The commands with `met`: every named value of the counter is as given; a counter that doesn't exist is all zeros."""
    both = commands.join(counters.select(*on, *(F.col(v).alias(f"_c_{v}") for v in values)), on, "left")
    met = F.lit(True)
    for v, n in values.items():
        met = met & (F.coalesce(F.col(f"_c_{v}"), F.lit(0)) == n)
    return both.withColumn("met", met).drop(*(f"_c_{v}" for v in values))


def admit(commands: DataFrame, key: list[str], order: list[str], delta: str, most: int | None = None, least: int | None = None, start: Column | None = None) -> DataFrame:
    """Which commands a bounded counter lets in, one key's commands after the other in the given order: a rejected one
    leaves the value as it is. Adds `admitted` and `value` (after it).

    Commands are sorted by key and order; a task reads them as they come and holds one value at a time, however many a
    key has. start: the value before, as a column that is equal for all of a key's commands. When all deltas of a key are
    one equal amount, the verdict is a rank and `admit_equal` needs no fold."""
    first = (start if start is not None else F.lit(0)).cast("bigint").alias("_s")
    given = commands.select(*key, *order, F.col(delta).cast("bigint").alias(delta), first)
    fields = [StructField(f.name, f.dataType) for f in given.schema.fields[:-1]]
    n_keys = len(key)

    def fold(batches):
        now, value = None, 0
        for b in batches:
            admitted, values = [], []
            deltas, starts = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            for k, x, begin in zip(zip(*(b.column(i).to_pylist() for i in range(n_keys)), strict=True), deltas, starts, strict=True):
                if k != now:
                    now, value = k, begin or 0
                to = value + (x or 0)
                ok = (most is None or x is None or x <= 0 or to <= most) and (least is None or x is None or x >= 0 or to >= least)
                value = to if ok else value
                admitted.append(ok)
                values.append(value)
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(admitted, pa.bool_()), pa.array(values, pa.int64())], names=[*b.schema.names[:-1], "admitted", "value"])

    in_order = given.repartition(*key).sortWithinPartitions(*key, *order)
    return in_order.mapInArrow(fold, StructType([*fields, StructField("admitted", BooleanType()), StructField("value", LongType())]))


def admit_equal(commands: DataFrame, key: list[str], order: list[str], amount: int, most: int) -> DataFrame:
    """As `admit` for equal positive amounts: the first most // amount commands of a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    rank = F.row_number().over(w)
    return commands.withColumn("admitted", rank <= most // amount)


def absence(commands: DataFrame, target: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The commands with `met`: no row of the target has the key, theirs -> ours, that a command names."""
    there = target.select(*(F.col(theirs).alias(ours) for theirs, ours in mapping.items())).distinct().withColumn("_there", F.lit(True))
    return commands.join(there, list(mapping.values()), "left").withColumn("met", F.col("_there").isNull()).drop("_there")


def overlay(stored: Column, written: Column) -> Column:
    """An item's attributes, a map, after a write: those that the schema doesn't know, or the write doesn't name, stay."""
    kept = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(written), k))
    return F.map_concat(kept, written)


def stamps(writes_: DataFrame, keys: list[str], at: str) -> DataFrame:
    """What items carry after their writes: when the first one made them, and when the last one changed them."""
    return writes_.groupBy(*keys).agg(F.min(at).alias("_created"), F.max(at).alias("_updated"))


def batched(commands: DataFrame, keys: list[str], order: list[str], outcome: str = "outcome") -> DataFrame:
    """Outcomes of a batch by item: commands tried, those done, and the first failure in order, if any. What fails, fails
    alone; the rest of the batch is done."""
    place = F.struct(*order)
    failed = F.when(F.col(outcome) != OK, F.struct(place.alias("p"), F.col(outcome).alias("o")))
    return commands.groupBy(*keys).agg(F.count(F.lit(1)).alias("tried"), F.count_if(F.col(outcome) == OK).alias("done"), F.min(failed)["o"].alias("failure"))


class BatchError(RuntimeError):
    """Commands of a batch that weren't done, as (key, outcome): the first by key, and how many there are in all."""

    def __init__(self, failures: list[tuple], total: int):
        super().__init__(f"{total} commands failed, {failures[0][0]} with {failures[0][1]} first")
        self.failures, self.total = failures, total


def batch_create(commands: DataFrame, snapshot: DataFrame, e: Entity, w: Write, now: int | None = None, order: str = "seq") -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """A batch of creates: the commands with their outcomes; the snapshot with the accepted ones in it; and what they add to each
    counter, merged, so that a counter item is written once a batch and not once a command."""
    done = create(commands, snapshot, e, w, now, order)
    accepted = done.filter(F.col("outcome") == OK).select(*snapshot.columns)
    after = snapshot.unionByName(accepted)
    merged = {c.name: counter_delta(accepted.limit(0), accepted, e, c) for c in e.counters}
    return done, after, merged


def raise_failures(done: DataFrame, keys: list[str], most: int = 100) -> None:
    """A BatchError if some command of a batch failed, with a report of the first `most` by key."""
    failed = done.filter(~F.col("outcome").isin(OK, UNCHANGED))
    first = failed.orderBy(*keys).limit(most).select(*keys, "outcome").collect()
    if first:
        raise BatchError([(tuple(r)[:-1], r["outcome"]) for r in first], failed.count() if len(first) == most else len(first))


def outcome_of_all(checks: list[tuple[str, str]]) -> Column:
    """A command applies wholly or not at all: the first of its failed checks (column, outcome), or ok."""
    return _first(*((~F.col(c), name) for c, name in checks))


def require_limit(name: str, limit: int | None) -> int:
    """A write that may raise a value bounded by its caller must be given the bound."""
    if limit is None:
        raise ValueError(f"{name} needs a limit")
    return limit


def transaction_size_ok(n: Column) -> Column:
    return n <= MAX_OPERATIONS


def batch_size(items_per_write: int) -> int:
    return max(1, MAX_OPERATIONS // items_per_write)


def waits(jitter: list[float]) -> list[float]:
    """Seconds before each retry of a commit that lost a race: doubling from the first up to the longest, times a jitter."""
    return [min(FIRST_WAIT * 2**i, LONGEST_WAIT) * j for i, j in enumerate(jitter[: RETRIES - 1])]


def changes_derived(e: Entity, w: Write) -> bool:
    """Whether an update touches what counters, claims, copies or index keys depend on; if not it is one conditional write."""
    changed = {*w.fields, *dict(w.set), *dict(w.add_to), *dict(w.remove_from)}
    return w.kind in ("create", "delete") or bool(changed & e.derived_inputs())


def holds_now(e: Entity, w: Write) -> Column:
    return holds(e, w.when)
