"""What a design's partitions hold and carry, and what is wrong with it: from declarations, and measured on rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions.keys import present, render
from keystrata.functions.preds import holds
from keystrata.model import Counter, Design, Entity, Index, Pred
from keystrata.operators import cost

# Thresholds of the findings, and their severities in order.
RANKS = {"error": 0, "warning": 1, "note": 2}
ITEM_LIMIT, ITEM_LARGE = 400 * 1024, 100 * 1024
TX_ITEMS, TX_BYTES = 100, 4 << 20
HOT_COUNTER, CONTENTION, CONTENTION_NOTE = 1000, 20, 5
RISK_HIGH, RISK_MEDIUM = 0.5, 0.1
LARGE_FIELD = 8 * 1024
# End of fixed values.


def items_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def partition_summary(rows: DataFrame, keys: list[str], family: str) -> DataFrame:
    """One row: how many partitions, how many items they hold typically and at most, and the busiest one's share."""
    per = items_per_key(rows, keys)
    return per.agg(
        F.lit(family).alias("family"),
        F.count(F.lit(1)).alias("partitions"),
        F.sum("n").alias("items"),
        F.avg("n").alias("typical"),
        F.max("n").alias("largest"),
        (F.max("n") / F.sum("n")).alias("busiest_share"),
    )


def risk(writes_per_s: Column, reads_per_s: Column) -> Column:
    """How much of what one partition can take its traffic uses."""
    use = F.greatest(writes_per_s / float(cost.PARTITION_WRITES), reads_per_s / float(cost.PARTITION_READS))
    return F.when(use >= RISK_HIGH, "high").when(use >= RISK_MEDIUM, "medium").otherwise("low")


def traffic(per_key: DataFrame, keys: list[str], write_rate: float, read_rate: float, peak: float, wru: Column, rru: Column) -> DataFrame:
    """Units a second of every partition at peak, when traffic is shared out by the items that partitions hold."""
    total = per_key.agg(F.sum("n").alias("_all"))
    share = F.col("n") / F.col("_all")
    both = per_key.crossJoin(F.broadcast(total))  # one row
    w, r = share * write_rate * peak * wru, share * read_rate * peak * rru
    return both.select(*keys, "n", w.alias("wru_s"), r.alias("rru_s"), risk(w, r).alias("risk"))


def largest_partitions(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    """A report of the largest partitions: a top-k, ties by key."""
    return items_per_key(rows, keys).orderBy(F.desc("n"), *keys).limit(top)


def lifecycle(rows: DataFrame, owner: list[str], state: str, order: list[str]) -> DataFrame:
    """Transitions of a state along each owner's rows, with counts; null stands for the start."""
    w = Window.partitionBy(*owner).orderBy(*order)
    return rows.select(F.lag(state).over(w).alias("from_state"), F.col(state).alias("to_state")).groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def final_states(rows: DataFrame, owner: list[str], state: str, order: list[str]) -> DataFrame:
    last = rows.groupBy(*owner).agg(F.max_by(state, F.struct(*order)).alias("final_state"))
    return last.groupBy("final_state").agg(F.count(F.lit(1)).alias("n"))


def counter_load(rows: DataFrame, key: list[str], at: str, unit: str = "hour") -> DataFrame:
    """Writes of every counter item in its busiest stretch of time."""
    per = rows.groupBy(*key, F.date_trunc(unit, F.col(at)).alias("_u")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*key).agg(F.max("n").alias("busiest"), F.sum("n").alias("writes"))


def alternatives(spark: SparkSession, design: Design, e: Entity, ix: Index) -> DataFrame:
    """The index as a GSI and as a copy: write and read units of the writes and reads that it takes part in."""
    from dataclasses import replace

    out = []
    for strategy in ("gsi", "copy"):
        changed = replace(e, indexes=tuple(replace(i, strategy=strategy) if i.name == ix.name else i for i in e.indexes))
        whole = replace(design, entities=tuple(changed if x.name == e.name else x for x in design.entities))
        for w in changed.writes:
            out.append((ix.name, strategy, "write", w.name, float(cost.write_cost(whole, changed, w)[0])))
        for a in changed.access:
            if a.target == ix.name:
                out.append((ix.name, strategy, "read", a.name, float(cost.read_cost(changed, a)[0])))
    return spark.createDataFrame(out, "index string, strategy string, kind string, name string, units double")


# --- findings on measured rows ----------------------------------------------------------------------------------------


def finding_item_size(rows: DataFrame, e: Entity, large: int = ITEM_LARGE, limit: int = ITEM_LIMIT) -> DataFrame:
    p99 = F.percentile(cost.observed_item_size(e), F.lit(0.99))
    return rows.agg(F.lit(e.name).alias("subject"), p99.alias("p99")).withColumn("severity", F.when(F.col("p99") > limit, "error").when(F.col("p99") > large, "warning").otherwise("none"))


def finding_large_field(rows: DataFrame, field: str, threshold: int = LARGE_FIELD) -> DataFrame:
    return rows.agg(F.lit(field).alias("subject"), F.percentile(F.octet_length(field), F.lit(0.99)).alias("p99")).withColumn("large", F.col("p99") >= threshold)


def finding_sparse_index(rows: DataFrame, e: Entity, name: str) -> DataFrame:
    """The share of rows that the index holds; a row is left out while a key field is missing."""
    ix = e.index(name)
    hit = present(e, ix.pk, ix.sk) & holds(e, ix.where)
    return rows.agg(F.lit(name).alias("subject"), F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_entries")).withColumn("share", F.col("n_entries") / F.col("n_rows"))


def finding_low_cardinality(rows: DataFrame, fields: list[str]) -> DataFrame:
    per = items_per_key(rows, fields)
    return per.agg(F.lit("+".join(fields)).alias("subject"), F.count(F.lit(1)).alias("n_keys"), F.max("n").alias("largest"))


def finding_unenforced_unique(rows: DataFrame, field: str) -> DataFrame:
    per = items_per_key(rows.filter(F.col(field).isNotNull()), [field]).filter("n > 1")
    return per.agg(F.lit(field).alias("subject"), F.count(F.lit(1)).alias("repeated_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_concerned"))


def finding_copy_drift(holders: DataFrame, source: DataFrame, on: list[tuple[str, str]], copy: str, original: str) -> DataFrame:
    """How many holders of a copied value differ from its source, and how many holders a source has."""
    s = source.select(*(F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(on)), F.col(original).alias("_o"))
    h = holders.select(*(F.col(a).alias(f"_k{i}") for i, (a, _) in enumerate(on)), F.col(copy).alias("_c"))
    both = h.join(s, [f"_k{i}" for i in range(len(on))])
    return both.agg(F.count(F.lit(1)).alias("holders"), F.count_if(~F.col("_c").eqNullSafe(F.col("_o"))).alias("drifted"))


def copy_fan_out(holders: DataFrame, key: list[str]) -> DataFrame:
    return items_per_key(holders, key).agg(F.count(F.lit(1)).alias("sources"), F.avg("n").alias("typical"), F.max("n").alias("most"))


# --- findings on the declared design ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Finding:
    rule: str
    severity: str
    subject: str
    text: str = ""


def findings(design: Design) -> list[Finding]:
    """Findings by severity, in the order found inside one."""
    out: list[Finding] = []
    add = lambda *x: out.append(Finding(*x))
    numbers = cost.counts(design)
    gsi_users: dict[str, list[str]] = {}
    for e in design.entities:
        p99 = cost.item_size(e)[1]
        if p99 > ITEM_LIMIT:
            add("item-too-large", "error", e.name, f"{p99} bytes")
        elif p99 > ITEM_LARGE:
            add("item-large", "warning", e.name, f"{p99} bytes")
        if e.ttl:
            for kind, names in (("ttl-counter", e.counters), ("ttl-claim", e.uniques), ("ttl-copy", [i for i in e.indexes if i.strategy == "copy"])):
                for x in names:
                    add(kind, "warning", f"{e.name}.{x.name}", "expiry bypasses it")
        read = {a.target for a in e.access}
        for ix in e.indexes:
            subject = f"{e.name}.{ix.name}"
            if ix.name not in read:
                add("unused-index", "warning", subject)
            if ix.project == "all":
                add("project-all", "note", subject)
            optional = [n for n in [*ix.pk.fields, *(ix.sk.fields if ix.sk else ())] if not e.field(n).required and e.field(n).type in ("string", "enum", "time") and n not in e.key_fields]
            if optional and not ix.where:
                add("sparse-index", "warning", subject, ", ".join(optional))
            if ix.strategy == "copy" and not any(a.target == ix.name and a.freshness == "immediate" for a in e.access):
                add("copy-not-needed", "note", subject)
            domains = [len(e.field(n).values) if e.field(n).type == "enum" else 2 if e.field(n).type == "bool" else None for n in ix.pk.fields]
            if domains and None not in domains:
                add("low-cardinality-key", "warning", subject, f"{domains} values")
            elif not domains:
                add("low-cardinality-key", "note", subject, "one partition")
            if ix.strategy == "gsi":
                gsi_users.setdefault(ix.name, []).append(e.name)
        for w in e.writes:
            p50, p99_, items = cost.write_cost(design, e, w)
            size = sum(t.size[1] * t.count for t in cost.touches(design, e, w) if not t.asynchronous)
            if items > TX_ITEMS:
                add("transaction-too-many-items", "error", f"{e.name}.{w.name}", str(items))
            if size > TX_BYTES:
                add("transaction-too-large", "error", f"{e.name}.{w.name}", str(size))
            changed = {*w.fields, *dict(w.set)}
            if w.kind in ("update", "patch"):
                for f in e.fields:
                    if f.sizes[1] >= LARGE_FIELD and f.name not in changed and w.rate:
                        add("large-field", "warning", f"{e.name}.{f.name}", w.name)
        for c in e.counters:
            share = busiest_share(design, e, c, numbers)
            if share is None:
                continue
            rate = share * sum(w.rate for w in e.writes if c.name in {t.name for t in cost.touches(design, e, w)}) * design.peak / c.shards
            if rate * 2 * cost.write_units(cost.counter_size(c, e)[0]) > HOT_COUNTER:
                add("hot-counter", "error", f"{e.name}.{c.name}", f"{rate:g}/s")
            elif rate > CONTENTION:
                add("counter-contention", "warning", f"{e.name}.{c.name}", f"{rate:g}/s")
            elif rate >= CONTENTION_NOTE:
                add("counter-contention", "note", f"{e.name}.{c.name}", f"{rate:g}/s")
        for a in e.access:
            if a.kind == "scan":
                add("scan", "note", f"{e.name}.{a.name}", a.reason)
    for name, users in gsi_users.items():
        if len(users) > 1:
            add("shared-gsi", "note", name, ", ".join(users))
    return sorted(out, key=lambda f: RANKS[f.severity])


def busiest_share(design: Design, e: Entity, c: Counter, numbers: dict[str, float | None]) -> float | None:
    """The share of an entity's writes that goes to the counter's busiest key: all where the key is constant, by the declared
    volumes where it is a parent's, evenly over the values of enums and bools; None where nothing tells."""
    names = list(dict.fromkeys(c.pk.fields + c.sk.fields))
    share = 1.0
    parent = next((p for p in design.entities if p.name == e.volume.per), None)
    for n in names:
        f = e.field(n)
        if f.type in ("enum", "bool"):
            share /= max(1, len(f.values) if f.type == "enum" else 2)
        elif parent is not None and (n in parent.key_fields or f.ref == parent.name) and e.volume.max and numbers.get(e.name):
            share *= min(1.0, e.volume.max / numbers[e.name])
        else:
            return None
    return share


def partition_sizes(design: Design) -> list[tuple[str, str, float]]:
    """Owner, space with partition-key template, and bytes of the largest partition, where the declared volumes tell them.

    An entity's own partition holds one item if it is the only one there, or its parent's most; a constant key holds all."""
    found: dict[str, list[tuple[float, str]]] = {}
    numbers = cost.counts(design)
    for e in design.entities:
        spaces = [("table", e.pk, e.singleton, cost.item_size(e)[0], 1.0)]
        spaces += [("table" if i.strategy == "copy" else i.name, i.pk, False, cost.entry_size(i, e)[0], i.matches) for i in e.indexes]
        for space, pk, alone, size, matches in spaces:
            if alone:
                n = 1.0
            elif not pk.fields:
                n = numbers.get(e.name)
            else:
                n = e.volume.max if e.volume.per else None
            if n is not None:
                found.setdefault(f"{space} {pk.raw}", []).append((n * matches * size, e.name))
    return [(max(parts)[1], key, sum(x for x, _ in parts)) for key, parts in found.items()]


def declared_lifecycle(e: Entity, state: str) -> list[tuple[str, str]]:
    """Transitions that the writes can make; "" is before creation."""
    f = e.field(state)
    out = []
    for w in e.writes:
        to = dict(w.set).get(state)
        if w.kind == "create":
            out += [("", v) for v in ([to] if to else f.values)]
        elif to is not None or state in w.fields:
            before = [v for v in f.values if all(p.matches(v) for p in w.when if p.field == state)]
            out += [(b, v) for b in before for v in ([to] if to else f.values) if b != v]
    return sorted(set(out))


def guarantees(e: Entity) -> list[str]:
    out = [f"{e.name}: {', '.join(u.fields)} is unique" for u in e.uniques]
    out += [f"{e.name}: {f.name} is never empty" for f in e.fields if f.required]
    for c in e.counters:
        out += [f"{c.name}.{v.name} is never above {v.limit}" for v in c.values if v.limit is not None]
        out += [f"{c.name}.{v.name} is never below {v.min}" for v in c.values if v.min is not None]
    for w in e.writes:
        out += [f"{e.name}.{w.name} needs a {r.entity}" for r in w.requires if not r.optional]
    return out


def apply_policy(found: DataFrame, policy: DataFrame) -> DataFrame:
    """Findings with the policy's severity where it names their rule."""
    p = policy.select("rule", F.col("severity").alias("_s"))
    return found.join(p, "rule", "left").withColumn("severity", F.coalesce("_s", "severity")).drop("_s")


def apply_acceptances(found: DataFrame, accepted: DataFrame) -> DataFrame:
    """Findings and whether one of the acceptances covers them: of their subject, or of the entity that it belongs to. An error
    can't be accepted; an acceptance that covers nothing is a finding of its own."""
    a = accepted.select("rule", F.col("subject").alias("_a"))
    entity = F.substring_index("subject", ".", 1)
    both = found.join(a, (found["rule"] == a["rule"]) & ((F.col("_a") == F.col("subject")) | (F.col("_a") == entity)), "left").drop(a["rule"])
    marked = both.select("rule", "severity", "subject", F.col("_a").isNotNull().alias("accepted")).distinct()
    marked = marked.withColumn("accepted", F.col("accepted") & (F.col("severity") != "error"))
    hits = found.select(F.col("rule").alias("_r"), F.col("subject").alias("_s"), F.col("severity").alias("_v"))
    covers = (hits["_r"] == accepted["rule"]) & ((hits["_s"] == accepted["subject"]) | (F.substring_index("_s", ".", 1) == accepted["subject"])) & (hits["_v"] != "error")
    stale = accepted.join(hits, covers, "left_anti").select(F.lit("accept-invalid").alias("rule"), F.lit("error").alias("severity"), F.concat_ws(":", "rule", "subject").alias("subject"), F.lit(False).alias("accepted"))
    return marked.unionByName(stale)


def parse_size(text: str) -> int:
    """Bytes of sizes like 64KB, in binary units."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(B|KB|MB|GB|TB)?\s*", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"{text!r} isn't a size")
    return int(float(m[1]) * 1024 ** ("B", "KB", "MB", "GB", "TB").index((m[2] or "B").upper()))


def families(design: Design) -> list[tuple[str, str, str]]:
    """Space (the table or a GSI), partition key template and the families of items under it."""
    out: list[tuple[str, str, str]] = []
    for e in design.entities:
        out.append(("table", e.pk.raw, e.name))
        out += [("table" if i.strategy == "copy" else i.name, i.pk.raw, f"{e.name}.{i.name}") for i in e.indexes]
        out += [("table", u.pk.raw, f"{e.name}.{u.name}") for u in e.uniques]
        out += [("table", c.pk.raw, f"{e.name}.{c.name}") for c in e.counters]
    return sorted(out)


def growth(e: Entity) -> str:
    """Whether its items only ever gather: created, but never deleted nor expired."""
    kinds = {w.kind for w in e.writes}
    return "bounded" if "delete" in kinds or e.ttl else "grows" if "create" in kinds else "fixed"


def key_collisions(everything: DataFrame) -> DataFrame:
    """Keys that items of several kinds share."""
    return everything.groupBy("PK", "SK").agg(F.count_distinct("_t").alias("kinds")).filter("kinds > 1")


def rendered(e: Entity, index: str) -> Column:
    return render(e.index(index).pk, e)


def matching(e: Entity, preds: tuple[Pred, ...]) -> Column:
    return holds(e, preds)
