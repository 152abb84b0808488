"""Predicates over fields of which a missing one counts as its type's zero value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keystrata.functions.keys import literal
from keystrata.model import Entity, Pred


def value_of(e: Entity, name: str, prefix: str = "") -> Column:
    """The field, or its zero where it is missing; times, lists and maps have no zero constant and stay null."""
    f = e.field(name)
    c = F.col(f"{prefix}`{name}`" if prefix else name)
    return c if f.zero is None else F.coalesce(c, literal(f.zero, f))


def holds(e: Entity, preds: tuple[Pred, ...], prefix: str = "", writer: str = "") -> Column:
    """All of the predicates, never null. prefix and writer qualify the columns of a join's two sides."""
    cond = F.lit(True)
    for p in preds:
        c = value_of(e, p.field, prefix)
        if p.source:
            hit = c.eqNullSafe(F.coalesce(F.col(f"{writer}`{p.source}`" if writer else p.source), literal(e.field(p.field).zero, e.field(p.field))))
        else:
            hit = F.coalesce(c.isin([v for v in p.values]), F.lit(False)) if len(p.values) > 1 else c.eqNullSafe(literal(p.values[0], e.field(p.field)))
        cond = cond & (~hit if p.negate else hit)
    return cond


def live(ttl: str | None, now: Column) -> Column:
    """Expired rows are absent everywhere, though they may still be stored. now: seconds since 1970."""
    if not ttl:
        return F.lit(True)
    c = F.col(ttl)
    return c.isNull() | (c == 0) | (c > now)
