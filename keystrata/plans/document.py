"""Reports of a design: Markdown with diagrams, a JSON snapshot, table properties, and the lock of its versions."""

from __future__ import annotations

import json
import os
from typing import Any

from keystrata.model import Design
from keystrata.operators import analysis, cost, evolve
from keystrata.plans.planner import relations, write_shape
from keystrata.sources.store import layout, physical


def human(n: float) -> str:
    for unit in ("B", "KB", "MB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.2f} GB"


def plural(n: int, word: str) -> str:
    return f"{n:,} {word}" + ("" if n == 1 else "es" if word.endswith(("s", "x", "ch")) else "s")


def snapshot(design: Design) -> dict[str, Any]:
    """Everything known of a design as plain values, for comparing designs."""
    numbers = cost.counts(design)
    return {
        "table": physical(design),
        "entities": {
            e.name: {
                "shape": evolve.shape(e),
                "fingerprint": evolve.fingerprint(evolve.shape(e)),
                "size": cost.item_size(e),
                "items": numbers[e.name],
                "month": round(cost.entity_month(design, e), 4),
                "storage": None if numbers[e.name] is None else cost.storage_bytes(e, numbers[e.name]),
                "layout": layout(design, e),
                "reads": {a.name: cost.read_cost(e, a) for a in e.access},
                "writes": {w.name: {"wru": cost.write_cost(design, e, w)[:2], "items": cost.write_cost(design, e, w)[2], "shape": write_shape(e, w)} for w in e.writes},
                "growth": analysis.growth(e),
            }
            for e in design.entities
        },
        "relations": relations(design),
        "partitions": [list(f) for f in analysis.families(design)],
        "largest_partitions": [list(p) for p in analysis.partition_sizes(design)],
        "lifecycles": {f"{e.name}.{f.name}": analysis.declared_lifecycle(e, f.name) for e in design.entities for f in e.fields if f.type == "enum" and e.writes},
        "guarantees": [g for e in design.entities for g in analysis.guarantees(e)],
        "findings": [[f.rule, f.severity, f.subject, f.text] for f in analysis.findings(design)],
    }


def markdown(design: Design) -> str:
    s = snapshot(design)
    out = [f"# {s['table']['name']}", "", "```mermaid", "erDiagram"]
    out += [f"  {a} }}o--|| {b} : {kind}" for a, b, kind in s["relations"]]
    out += ["```", "", "| Entity | Key | Items | Size p50/p99 | Month |", "|-|-|-|-|-|"]
    for e in design.entities:
        x = s["entities"][e.name]
        items = "not declared" if x["items"] is None else f"{x['items']:,.0f}"
        out.append(f"| {e.name} | `{e.pk.raw}` / `{e.sk.raw}` | {items} | {human(x['size'][0])} / {human(x['size'][1])} | ${x['month']:.2f} |")
    for e in design.entities:
        x = s["entities"][e.name]
        out += ["", f"## {e.name}", ""]
        out += [f"- reads {n}: {r[0]:g}/{r[1]:g} read units" for n, r in x["reads"].items()]
        out += [f"- writes {n}: {w['wru'][0]:g}/{w['wru'][1]:g} write units, {plural(w['items'], 'item')}, {w['shape'].replace('_', ' ')}" for n, w in x["writes"].items()]
        out += [f"- {g}" for g in analysis.guarantees(e)]
    out += ["", "## Partitions", ""] + [f"- {space} `{pk}`: {family}" for space, pk, family in s["partitions"]]
    out += [f"- largest `{key}`: {human(size)} ({owner})" for owner, key, size in s["largest_partitions"]]
    for name, steps in s["lifecycles"].items():
        if any(a for a, _ in steps):
            out += ["", f"## States of {name}", "", "```mermaid", "stateDiagram-v2", *(f"  {a or '[*]'} --> {b}" for a, b in steps), "```"]
    out += ["", "## Findings", ""] + [f"- {sev}: {rule} {subject} {text}".rstrip() for rule, sev, subject, text in s["findings"]]
    return "\n".join(out) + "\n"


def terraform(design: Design) -> str:
    """A resource of the table as JSON."""
    p = physical(design)
    attributes = [p["pk"], p["sk"], *(k for g in p["gsis"].values() for k in (g["pk"], g["sk"]) if k)]
    gsis = [{"name": n, "hash_key": g["pk"], **({"range_key": g["sk"]} if g["sk"] else {}), "projection_type": "ALL" if g["all"] else "INCLUDE", **({} if g["all"] else {"non_key_attributes": g["fields"]})} for n, g in p["gsis"].items()]
    body = {"name": p["name"], "billing_mode": "PAY_PER_REQUEST", "hash_key": p["pk"], "range_key": p["sk"], "attribute": [{"name": a, "type": "S"} for a in attributes], "global_secondary_index": gsis, "ttl": {"attribute_name": p["ttl"], "enabled": any(e.ttl for e in design.entities)}}
    return json.dumps({"resource": {"aws_dynamodb_table": {design.table: body}}}, indent=2)


def create_request(design: Design) -> str:
    """The same as the body of a request to make the table."""
    p = physical(design)
    key = lambda pk, sk: [{"AttributeName": pk, "KeyType": "HASH"}, *([{"AttributeName": sk, "KeyType": "RANGE"}] if sk else [])]
    names = [p["pk"], p["sk"], *(k for g in p["gsis"].values() for k in (g["pk"], g["sk"]) if k)]
    return json.dumps(
        {
            "TableName": p["name"],
            "BillingMode": "PAY_PER_REQUEST",
            "AttributeDefinitions": [{"AttributeName": n, "AttributeType": "S"} for n in names],
            "KeySchema": key(p["pk"], p["sk"]),
            "GlobalSecondaryIndexes": [{"IndexName": n, "KeySchema": key(g["pk"], g["sk"]), "Projection": {"ProjectionType": "ALL"} if g["all"] else {"ProjectionType": "INCLUDE", "NonKeyAttributes": g["fields"]}} for n, g in p["gsis"].items()],
        },
        indent=2,
    )


def read_lock(path: str) -> dict[str, Any]:
    if not os.path.exists(path):
        return {"generation": 1, "entities": {}}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_lock(path: str, design: Design) -> list[str]:
    """Updates the lock to a design's shapes and says what that means for stored items."""
    lock = read_lock(path)
    notes, needs = [], False
    for e in design.entities:
        verdict, why = evolve.next_version(lock["entities"].get(e.name), e)
        needs |= verdict == "new_generation"
        notes += [f"{e.name}: {x}" for x in why]
    notes += [f"{n} is gone" for n in lock["entities"] if all(e.name != n for e in design.entities)]
    if needs and design.generation <= lock["generation"]:
        notes.append(f"raise the table's generation above {lock['generation']}")
        return notes
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"generation": design.generation, "entities": {e.name: evolve.shape(e) for e in design.entities}}, f, indent=1, sort_keys=True)
    return notes
