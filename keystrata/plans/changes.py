"""What changed between two designs, section by section, and reading a design as it was at a commit."""

from __future__ import annotations

import os
import subprocess
from typing import Any

from keystrata.model import Design, load_design, load_text
from keystrata.operators import analysis, cost, evolve

#: A number counts as changed if it moved by more than this share of what it was.
SIGNIFICANT = evolve.SIGNIFICANT
# Sections in the order in which a reader meets them.
SECTIONS = ("Workload", "Entities", "Fields", "Indexes", "Uniqueness and counters", "Reads", "Writes", "Guarantees", "Partitions", "Findings", "Costs")
# End of fixed values.


def at_revision(path: str, revision: str) -> Design:
    """The design in a file as it stood at a revision of its git repository."""
    folder, name = os.path.split(os.path.abspath(path))
    shown = subprocess.run(["git", "-C", folder, "show", f"{revision}:./{name}"], capture_output=True, text=True, check=False)
    if shown.returncode:
        raise OSError(shown.stderr.strip() or f"{path} isn't known at {revision}")
    return load_text(shown.stdout, name)


def load_any(source: str) -> Design:
    """A design from a file, or from revision:file where no such file exists."""
    if not os.path.exists(source) and ":" in source:
        revision, _, path = source.partition(":")
        return at_revision(path, revision)
    return load_design(source)


def facts(design: Design) -> dict[tuple[str, str], Any]:
    """Everything that a section compares: (section, subject) -> value. Numbers and pairs of numbers compare as such."""
    out: dict[tuple[str, str], Any] = {("Workload", "peak"): float(design.peak)}
    numbers = cost.counts(design)
    for e in design.entities:
        s = evolve.shape(e)
        out["Entities", e.name] = f"{e.pk.raw} / {e.sk.raw}" + (f", expires by {e.ttl}" if e.ttl else "")
        if numbers.get(e.name) is not None:
            out["Workload", f"{e.name} items"] = float(numbers[e.name])
        for part, section in (("fields", "Fields"), ("indexes", "Indexes"), ("uniques", "Uniqueness and counters"), ("counters", "Uniqueness and counters")):
            out |= {(section, f"{e.name}.{n}"): d for n, d in s[part].items()}
        for a in e.access:
            out["Reads", f"{e.name}.{a.name}"] = f"{a.kind} {a.target} {a.range} {a.order} {a.page} {a.freshness}".strip()
            out["Costs", f"{e.name}.{a.name} read units"] = cost.read_cost(e, a)[0]
            if a.rate:
                out["Workload", f"{e.name}.{a.name} a second"] = float(a.rate)
        for w in e.writes:
            p50, _, items = cost.write_cost(design, e, w)
            out["Writes", f"{e.name}.{w.name}"] = f"{w.kind} {sorted({*w.fields, *dict(w.set)})} when {[str(p) for p in w.when]} requires {[r.entity for r in w.requires]}"
            out["Costs", f"{e.name}.{w.name} write units"] = p50
            out["Costs", f"{e.name}.{w.name} items"] = float(items)
            if w.rate:
                out["Workload", f"{e.name}.{w.name} a second"] = float(w.rate)
        out |= {("Guarantees", g): True for g in analysis.guarantees(e)}
        out["Costs", f"{e.name} a month"] = float(cost.entity_month(design, e))
    members: dict[str, list[str]] = {}
    for space, template, family in analysis.families(design):
        members.setdefault(f"{space} {template}", []).append(family)
    out |= {("Partitions", k): ", ".join(v) for k, v in members.items()}
    seen: dict[tuple[str, str], int] = {}
    for f in analysis.findings(design):
        n = seen[f.rule, f.subject] = seen.get((f.rule, f.subject), 0) + 1
        out["Findings", f"{f.rule} {f.subject}" + (f" #{n}" if n > 1 else "")] = f.severity
    return out


def moved(a: Any, b: Any) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return abs(b - a) > abs(a) * SIGNIFICANT
    return a != b


def diff(old: Design | None, new: Design) -> list[tuple[str, str, str, str, str]]:
    """section, subject, change, was, now: in the order of the sections, then by subject. Without an old design all is added."""
    a, b = facts(old) if old else {}, facts(new)
    out = []
    for key in sorted(a.keys() | b.keys(), key=lambda k: (SECTIONS.index(k[0]), k[1])):
        if key not in a:
            change = "added"
        elif key not in b:
            change = "removed"
        elif moved(a[key], b[key]):
            change = "changed"
        else:
            continue
        text = lambda side: "" if key not in side else f"{side[key]:g}" if isinstance(side[key], float) else str(side[key])  # noqa: B023, E731
        out.append((*key, change, text(a), text(b)))
    return out


def generation_needed(old: Design, new: Design) -> list[str]:
    """What stored items wouldn't survive, entity by entity."""
    out = []
    before = {e.name: e for e in old.entities}
    for e in new.entities:
        if e.name in before:
            out += [f"{e.name}: {n}" for n in evolve.next_version(evolve.shape(before[e.name]), e)[1] if n.endswith("needs a new generation")]
    return out


def text(old: Design | None, new: Design) -> str:
    """The differences as Markdown; nothing where there are none."""
    rows = diff(old, new)
    if not rows:
        return ""
    out = [f"### `{new.table}`: what changes", ""]
    if old and (needs := generation_needed(old, new)):
        out += ["Stored items have to be copied to a new generation:", "", *(f"- {n}" for n in needs), ""]
    for section in SECTIONS:
        lines = [f"- {subject}: {change}" + (f", {was} to {now}" if change == "changed" else f", {now or was}") for s, subject, change, was, now in rows if s == section]
        if lines:
            out += [f"#### {section}", "", *lines, ""]
    return "\n".join(out)
