"""A team's policy for designs: severities, limits and requirements, and at which severity a check fails."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

import yaml

from keystrata.model import Design, DesignError
from keystrata.operators import cost
from keystrata.operators.analysis import RANKS, Finding, findings, parse_size, partition_sizes
from keystrata.sources.store import physical

# Names that a policy may use. Limits of the store itself can't be lowered by a policy.
LIMITS = ("item_size", "partition_size", "transaction_items", "gsis", "indexes_per_entity")
REQUIREMENTS = ("volumes", "rates", "freshness")
OF_THE_STORE = frozenset("item-too-large transaction-too-many-items transaction-too-large accept-invalid".split())
RULES = OF_THE_STORE | frozenset(
    "hot-partition hot-counter counter-contention low-cardinality-key sparse-index unenforced-unique unused-index copy-drift item-large large-field "
    "ttl-counter ttl-claim ttl-copy copy-not-needed scan project-all shared-gsi volume-missing rate-missing freshness-unstated "
    "item-size-limit partition-size-limit transaction-items-limit gsi-limit index-limit".split()
)
# End of fixed values.


@dataclass(frozen=True)
class Policy:
    fail_on: str = "error"
    severities: dict[str, str] = field(default_factory=dict)
    limits: dict[str, int] = field(default_factory=dict)
    require: frozenset[str] = frozenset()


def read_policy(raw: str | dict[str, Any] | None) -> Policy:
    """A policy from YAML text or plain values: fail_on, rules, limits, require. Every fault is told at once."""
    raw = (yaml.safe_load(raw) if isinstance(raw, str) else raw) or {}
    if not isinstance(raw, dict):
        raise DesignError(["policy: expected a mapping"])
    faults = [f"policy: unknown key {k!r}" for k in raw if k not in ("fail_on", "rules", "limits", "require")]
    fail_on = raw.get("fail_on") or "error"
    if fail_on not in RANKS:
        faults.append(f"policy: fail_on is one of {', '.join(RANKS)}")
    rules = raw.get("rules") or {}
    for name, severity in rules.items():
        if name not in RULES:
            faults.append(f"policy: there is no rule {name!r}")
        elif name in OF_THE_STORE:
            faults.append(f"policy: {name} is a limit of the store")
        elif severity not in RANKS and str(severity) != "off" and severity is not False:
            faults.append(f"policy: {name} is error, warning, note or off, not {severity!r}")
    limits: dict[str, int] = {}
    for name, value in (raw.get("limits") or {}).items():
        if name not in LIMITS:
            faults.append(f"policy: unknown limit {name!r}")
            continue
        try:
            n = parse_size(str(value)) if name.endswith("_size") else int(value)
        except ValueError as err:
            faults.append(f"policy: {name}: {err}")
            continue
        if n <= 0:
            faults.append(f"policy: {name} must be above zero")
        limits[name] = n
    wanted = raw.get("require") or {}
    faults += [f"policy: unknown requirement {k!r}" for k in wanted if k not in REQUIREMENTS]
    if faults:
        raise DesignError(faults)
    return Policy(fail_on, {k: "off" if v is False else v for k, v in rules.items()}, limits, frozenset(k for k, v in wanted.items() if v))


def own_findings(design: Design, policy: Policy) -> list[Finding]:
    """What only a policy asks for: its limits and requirements, as warnings."""
    out: list[Finding] = []
    add = lambda rule, subject, text: out.append(Finding(rule, "warning", subject, text))
    most, numbers = policy.limits, cost.counts(design)
    for e in design.entities:
        p99 = cost.item_size(e)[1]
        if p99 > most.get("item_size", p99):
            add("item-size-limit", e.name, f"{p99} bytes, {most['item_size']} allowed")
        if len(e.indexes) > most.get("indexes_per_entity", len(e.indexes)):
            add("index-limit", e.name, f"{len(e.indexes)} indexes, {most['indexes_per_entity']} allowed")
        for w in e.writes:
            n = cost.write_cost(design, e, w)[2]
            if n > most.get("transaction_items", n):
                add("transaction-items-limit", f"{e.name}.{w.name}", f"{n} items, {most['transaction_items']} allowed")
        if "rates" in policy.require:
            for x in (*e.access, *e.writes):
                if not x.rate:
                    add("rate-missing", f"{e.name}.{x.name}", "no rate")
        if "freshness" in policy.require:
            for a in e.access:
                if not a.freshness:
                    add("freshness-unstated", f"{e.name}.{a.name}", "no freshness")
        if "volumes" in policy.require and numbers.get(e.name) is None:
            add("volume-missing", e.name, "no volume")
    for owner, template, size in partition_sizes(design):
        if size > most.get("partition_size", size):
            add("partition-size-limit", owner, f"{template}: {size:.0f} bytes, {most['partition_size']} allowed")
    n = len(physical(design)["gsis"])
    if n > most.get("gsis", n):
        add("gsi-limit", design.table, f"{n} GSIs, {most['gsis']} allowed")
    return out


def check(design: Design, policy: Policy | None = None) -> list[Finding]:
    """All findings with the policy's severities, those that it turns off left out, by severity."""
    policy = policy or Policy()
    out = []
    for f in findings(design) + own_findings(design, policy):
        severity = policy.severities.get(f.rule, f.severity)
        if severity != "off":
            out.append(replace(f, severity=severity))
    return sorted(out, key=lambda f: RANKS[f.severity])


def fails(found: list[Finding], policy: Policy | None = None) -> bool:
    """Whether a finding is as severe as the policy fails on."""
    return any(RANKS[f.severity] <= RANKS[(policy or Policy()).fail_on] for f in found)
