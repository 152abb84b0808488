"""Key templates as columns: rendering, splitting, and the conditions on fields that a key condition stands for."""

from __future__ import annotations

import re
import unicodedata
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from keystrata.model import MAX_PK, MAX_SK, Entity, Field, Template

#: Sorts after every character that a key may go on with.
LAST = "\U0010ffff"


def fmt_int(c: Column) -> Column:
    """Nineteen digits; a negative number is a minus and its distance from the least one, so that text sorts as numbers do."""
    shifted = (c.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string")
    return F.when(c >= 0, F.lpad(c.cast("string"), 19, "0")).otherwise(F.concat(F.lit("-"), F.lpad(shifted, 19, "0")))


def fmt_time(c: Column) -> Column:
    """UTC with nine digits of a second; Spark knows six."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'")


def fmt(c: Column, f: Field, lower: bool = False) -> Column:
    if f.type == "int":
        return fmt_int(c)
    if f.type == "time":
        return fmt_time(c)
    if f.type == "bool":
        return c.cast("string")
    return lowered(c) if lower else c


def _composed(x: str | None) -> str | None:
    return x if x is None or x.isascii() else unicodedata.normalize("NFC", x)


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Unicode's composed form (NFC), which has no built-in function. ASCII texts are returned as they are."""
    return text.map(_composed)


@F.pandas_udf(ArrayType(StringType()))
def composed_elements(texts: pd.Series) -> pd.Series:
    return texts.map(lambda xs: None if xs is None else [_composed(x) for x in xs])


def lowered(c: Column) -> Column:
    """Text as keys hold it that don't tell cases apart: composed, then lower-cased."""
    return F.lower(composed(c))


def lowered_elements(c: Column) -> Column:
    return F.transform(composed_elements(c), lambda x: F.lower(x))


def lowered_value(x: Any) -> Any:
    return _composed(x).lower() if isinstance(x, str) else x


def render(t: Template, e: Entity, element: tuple[str, Column] | None = None) -> Column:
    """The rendered key. element: the name of a set field, and the column of the one element to render."""
    parts = []
    for p in t.parts:
        if not p.field:
            parts.append(F.lit(p.literal))
        else:
            c = element[1] if element and element[0] == p.field else F.col(p.field)
            parts.append(fmt(c, e.field(p.field), p.lower))
    return F.concat(*parts)


def item_key(e: Entity) -> tuple[Column, Column]:
    return render(e.pk, e).alias("PK"), render(e.sk, e).alias("SK")


def split(key: Column, t: Template) -> dict[str, Column]:
    """Field values, as text, read back out of a rendered key: each ends where the literal after it first stands."""
    pattern = "^(?s)"
    for p in t.parts:
        pattern += re.escape(p.literal) if not p.field else "(.*?)" if p is not t.parts[-1] else "(.*)"
    names = [p.field for p in t.parts if p.field]
    return {n: F.regexp_extract(key, pattern + "$", i + 1) for i, n in enumerate(names)}


def literal(value: Any, f: Field) -> Column:
    kind = {"int": "bigint", "float": "double", "bool": "boolean", "time": None}.get(f.type, "string")
    return F.lit(value) if kind is None else F.lit(value).cast(kind)


def fields_equal(e: Entity, values: dict[str, Any]) -> Column:
    """A condition on a rendered key as one on its native fields, which reaches the file scan."""
    cond = F.lit(True)
    for name, v in values.items():
        cond = cond & (F.col(name) == (v if isinstance(v, Column) else literal(v, e.field(name))))
    return cond


def bounds(e: Entity, t: Template, name: str, low: Any = None, high: Any = None) -> Column:
    """A key range as one on the native field. Both ends count; for text the upper end also admits what begins with it."""
    f = e.field(name)
    part = next(p for p in t.parts if p.field == name)
    c = lowered(F.col(name)) if part.lower else F.col(name)
    if part.lower:
        low, high = lowered_value(low), lowered_value(high)
    cond = F.lit(True)
    if low is not None:
        cond = cond & (c >= literal(low, f))
    if high is not None:
        top = c <= literal(high, f)
        cond = cond & (top | c.startswith(str(high)) if f.type in ("string", "enum") else top)
    return cond


def present(e: Entity, *templates: Template | None, element: tuple[str, Column] | None = None) -> Column:
    """All fields of the templates that may be missing hold something."""
    cond = F.lit(True)
    for name in dict.fromkeys(n for t in templates if t for n in t.fields):
        f = e.field(name)
        c = element[1] if element and element[0] == name else F.col(name)
        if f.type == "time":
            cond = cond & c.isNotNull()
        elif f.type in ("string", "enum", "string_set"):
            cond = cond & c.isNotNull() & (c != "")
    return cond


def separators_ok(e: Entity) -> Column:
    """No text field of the key holds the first character of the literal that follows it, in either case."""
    cond = F.lit(True)
    for t in (e.pk, e.sk):
        for p, q in zip(t.parts, t.parts[1:], strict=False):
            if p.field and not q.field and e.field(p.field).type in ("string", "enum"):
                sep = q.literal[0]
                c = F.coalesce(F.col(p.field), F.lit(""))
                cond = cond & ~(c.contains(sep) | F.lower(c).contains(sep))
    return cond


def lengths_ok(pk: Column, sk: Column) -> Column:
    return (F.octet_length(pk) <= MAX_PK) & (F.octet_length(sk) <= MAX_SK)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    # A character for every byte; as an element of an array, so that the key is rendered once and not for every byte.
    letters = F.filter(F.split(F.decode(text.cast("binary"), "ISO-8859-1"), ""), lambda c: c != "")
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(0xFFFFFFFF)
    return F.transform(F.array(letters), lambda x: F.aggregate(x, F.lit(2166136261).cast("bigint"), step))[0]


def shard_of(pk: Column, sk: Column, shards: int) -> Column:
    return (fnv1a(F.concat(pk, F.lit("\0"), sk)) % shards).cast("int")


def shard_key(pk: Column, shard: Column, shards: int) -> Column:
    return pk if shards == 1 else F.concat(pk, F.lit("#S"), shard.cast("string"))


def version_text(rev: Column) -> Column:
    """The revision in base 36; nothing for none."""
    return F.when(rev > 0, F.lower(F.conv(rev.cast("string"), 10, 36))).otherwise(F.lit(""))
