"""The declared design: entities, key templates, derived items, reads and writes. Lives on the driver and never changes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

# Field types, with default sizes (p50, p99) in bytes.
TYPES = {
    "string": (20, 64), "enum": (0, 0), "int": (8, 11), "float": (8, 11), "bool": (1, 1), "time": (30, 35),
    "bytes": (200, 2000), "string_list": (60, 400), "string_set": (60, 400), "string_map": (120, 800),
}
KEY_TYPES = frozenset(("string", "enum", "int", "bool", "time", "string_set"))
SPARSE_TYPES = frozenset(("string", "enum", "time", "string_set"))
SPARK_TYPES = {
    "string": "string", "enum": "string", "int": "bigint", "float": "double", "bool": "boolean", "time": "timestamp",
    "bytes": "binary", "string_list": "array<string>", "string_set": "array<string>", "string_map": "map<string,string>",
}
RESERVED = frozenset(("PK", "SK", "_t", "_v", "_rev", "_created", "_updated"))
MAX_PK, MAX_SK = 2048, 1024
DEFAULT_PAGE, LEAST_MAX_PAGE, PAGE_LIMIT = 50, 100, 1000
MAX_SHARDS, MAX_GSIS, MAX_PROJECTED = 100, 20, 100
# End of fixed values.


class DesignError(ValueError):
    """Everything that is wrong with a schema, not only the first fault."""

    def __init__(self, faults: list[str]):
        super().__init__("\n".join(faults))
        self.faults = faults


@dataclass(frozen=True)
class Part:
    """Literal text, or a field with an optional lower-case transform."""

    literal: str = ""
    field: str = ""
    lower: bool = False


@dataclass(frozen=True)
class Template:
    raw: str
    parts: tuple[Part, ...]

    @property
    def fields(self) -> list[str]:
        return list(dict.fromkeys(p.field for p in self.parts if p.field))

    @property
    def prefix(self) -> str:
        return self.parts[0].literal if self.parts and not self.parts[0].field else ""

    @property
    def constant(self) -> bool:
        return not self.fields

    def first_field(self) -> str | None:
        """The first placeholder, if nothing but the literal prefix stands before it."""
        return next((p.field for p in self.parts[:2] if p.field), None)

    def literals(self) -> list[str]:
        """The texts before, between and after the placeholders."""
        out = [""]
        for p in self.parts:
            if p.field:
                out.append("")
            else:
                out[-1] += p.literal
        return out


def parse_template(raw: str) -> Template:
    """Splits a template into its parts; neighbouring placeholders need text between them."""
    parts: list[Part] = []
    at = 0
    if not raw:
        raise ValueError("a key template needs text or a field")
    for m in re.finditer(r"\{([^{}\s|]*)(?:\|([^{}]*))?\}", raw):
        literal = raw[at : m.start()]
        if not m[1]:
            raise ValueError(f"key template {raw!r}: braces without a field in them")
        if m[2] not in (None, "lower"):
            raise ValueError(f"key template {raw!r}: {m[2]!r} isn't a change that a key knows, only lower is")
        if literal:
            parts.append(Part(literal=literal))
        elif parts and parts[-1].field:
            raise ValueError(f"key template {raw!r}: two fields side by side can't be told apart, put text between them")
        parts.append(Part(field=m[1], lower=m[2] == "lower"))
        at = m.end()
    if raw[at:]:
        parts.append(Part(literal=raw[at:]))
    if any(c in p.literal for p in parts for c in "{}"):
        raise ValueError(f"key template {raw!r}: a brace is left open")
    return Template(raw, tuple(parts))


def may_overlap(a: Template, b: Template) -> bool:
    """Whether some values could render both to one key: their literals don't rule it out from either end."""
    if a.constant and b.constant:
        return a.raw == b.raw
    if a.constant or b.constant:
        c, t = (a, b) if a.constant else (b, a)
        pattern = "".join(re.escape(p.literal) if not p.field else "(?s:.*)" for p in t.parts)
        return re.fullmatch(pattern, c.raw) is not None
    x, y = a.literals(), b.literals()
    n, m = min(len(x[0]), len(y[0])), min(len(x[-1]), len(y[-1]))
    return x[0][:n] == y[0][:n] and x[-1][len(x[-1]) - m :] == y[-1][len(y[-1]) - m :]


def prefix_collision(a: Template, b: Template) -> bool:
    """Whether a query for one family by its literal prefix could also read the other."""
    return a.prefix.startswith(b.prefix) or b.prefix.startswith(a.prefix)


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    values: tuple[str, ...] = ()
    required: bool = False
    size: tuple[int, int] | None = None
    ref: str = ""
    copy_of: str = ""
    snapshot_of: str = ""
    attr: str = ""

    @property
    def attribute(self) -> str:
        """The name under which items hold the field."""
        return self.attr or self.name

    @property
    def sizes(self) -> tuple[int, int]:
        if self.size:
            return self.size
        if self.type == "enum":
            return (max(map(len, self.values), default=0),) * 2
        return TYPES[self.type]

    @property
    def zero(self) -> Any:
        return {"int": 0, "float": 0.0, "bool": False, "string": "", "enum": ""}.get(self.type)


@dataclass(frozen=True)
class Pred:
    """field equal to a value, differing from one (negate), or one of several; or equal to a field of the writer (source)."""

    field: str
    values: tuple = ()
    negate: bool = False
    source: str = ""

    def matches(self, value: Any) -> bool:
        return (value in self.values) != self.negate

    def allowed(self, f: Field) -> tuple | None:
        """The values of an enum or bool that satisfy it; None for other types."""
        domain = f.values + ("",) if f.type == "enum" else (False, True) if f.type == "bool" else None
        return None if domain is None else tuple(v for v in domain if self.matches(v))


def implies(q: tuple[Pred, ...], p: Pred, f: Field) -> bool | None:
    """Whether the conditions q make p true: yes, no, or not known (None)."""
    known = [x for x in q if x.field == p.field and not x.source]
    if not known or p.source:
        return None
    domain = known[0].allowed(f)
    if domain is None:
        exact = [x.values for x in known if not x.negate]
        if not exact:
            return False if any(x.negate and not p.negate and set(p.values) <= set(x.values) for x in known) else None
        domain = exact[0]
    left = [v for v in domain if all(x.matches(v) for x in known)]
    hits = {p.matches(v) for v in left}
    return None if len(hits) != 1 else hits.pop()


@dataclass(frozen=True)
class Index:
    name: str
    pk: Template
    sk: Template | None = None
    strategy: str = "gsi"
    where: tuple[Pred, ...] = ()
    project: str | tuple[str, ...] = "all"
    matches: float = 1.0


@dataclass(frozen=True)
class Unique:
    name: str
    fields: tuple[str, ...]
    pk: Template
    sk: Template
    element: str = ""


@dataclass(frozen=True)
class Value:
    name: str
    sum: str = ""
    where: tuple[Pred, ...] = ()
    limit: int | str | None = None
    min: int | None = None


@dataclass(frozen=True)
class Counter:
    name: str
    pk: Template
    sk: Template
    values: tuple[Value, ...]
    shards: int = 1


@dataclass(frozen=True)
class Access:
    name: str
    kind: str  # get, batch, unique, query, partition, counter, counter_all, scan
    target: str = "key"
    range: str = ""
    order: str = "asc"
    page: int = DEFAULT_PAGE
    max_page: int = LEAST_MAX_PAGE
    project: tuple[str, ...] = ()
    freshness: str = ""
    rate: float = 0.0
    reason: str = ""


@dataclass(frozen=True)
class Require:
    entity: str
    key: tuple[tuple[str, str], ...]
    when: tuple[Pred, ...] = ()
    set: tuple[tuple[str, Any], ...] = ()
    add: tuple[tuple[str, Any], ...] = ()
    patch: tuple[tuple[str, str], ...] = ()
    optional: bool = False
    consume: bool = False
    ensure: bool = False


@dataclass(frozen=True)
class Write:
    name: str
    kind: str  # create, update, patch, delete
    fields: tuple[str, ...] = ()
    set: tuple[tuple[str, Any], ...] = ()
    add_to: tuple[tuple[str, str], ...] = ()
    remove_from: tuple[tuple[str, str], ...] = ()
    when: tuple[Pred, ...] = ()
    requires: tuple[Require, ...] = ()
    versioned: str = ""
    batch: int = 0
    rate: float = 0.0


@dataclass(frozen=True)
class Volume:
    total: float | None = None
    per: str = ""
    typical: float | None = None
    max: float | None = None


@dataclass(frozen=True)
class Entity:
    name: str
    fields: tuple[Field, ...]
    pk: Template
    sk: Template
    version: int = 1
    ttl: str = ""
    indexes: tuple[Index, ...] = ()
    uniques: tuple[Unique, ...] = ()
    counters: tuple[Counter, ...] = ()
    access: tuple[Access, ...] = ()
    writes: tuple[Write, ...] = ()
    volume: Volume = field(default_factory=Volume)

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    @property
    def key_fields(self) -> list[str]:
        return list(dict.fromkeys(self.pk.fields + self.sk.fields))

    @property
    def singleton(self) -> bool:
        """At most one in a partition: the sort key has no field that the partition key lacks."""
        return set(self.sk.fields) <= set(self.pk.fields)

    def _named(self, kind: str, name: str):
        return next(x for x in getattr(self, kind) if x.name == name)

    def index(self, name: str) -> Index:
        return self._named("indexes", name)

    def unique(self, name: str) -> Unique:
        return self._named("uniques", name)

    def counter(self, name: str) -> Counter:
        return self._named("counters", name)

    def write(self, name: str) -> Write:
        return self._named("writes", name)

    def reads(self, name: str) -> Access:
        return self._named("access", name)

    def projection(self, index: Index) -> list[str]:
        """Fields of an index's rows: the key's, those of the index's keys, and the projected ones, in entity order."""
        if index.project == "all":
            return [f.name for f in self.fields]
        named = set(self.key_fields) | set(index.pk.fields) | set(index.sk.fields if index.sk else ())
        named |= set() if index.project == "keys" else set(index.project)
        return [f.name for f in self.fields if f.name in named]

    def derived_inputs(self) -> set[str]:
        """Fields that some counter, claim, copy or index key depends on."""
        out: set[str] = set()
        for ix in self.indexes:
            out |= set(ix.pk.fields) | set(ix.sk.fields if ix.sk else ()) | {p.field for p in ix.where}
            out |= set(self.projection(ix)) if ix.strategy == "copy" else set()
        for u in self.uniques:
            out |= set(u.fields)
        for c in self.counters:
            out |= set(c.pk.fields) | set(c.sk.fields)
            out |= {p.field for v in c.values for p in v.where} | {v.sum for v in c.values if v.sum}
        return out


@dataclass(frozen=True)
class Design:
    entities: tuple[Entity, ...]
    table: str = "items"
    generation: int = 1
    ttl_attribute: str = "ttl"
    peak: float = 1.0

    def entity(self, name: str) -> Entity:
        return next(e for e in self.entities if e.name == name)

    def without(self, name: str) -> Design:
        return replace(self, entities=tuple(e for e in self.entities if e.name != name))


# --- reading a schema -------------------------------------------------------------------------------------------------

_KEYS = {
    "file": "version package table output workload entities",
    "entity": "doc version fields key ttl indexes unique counters access writes volume accept",
    "field": "type values required size ref copy_of snapshot_of example doc attr",
    "key": "pk sk",
    "index": "doc pk sk strategy where project matches accept",
    "unique": "doc fields pk sk accept",
    "counter": "doc pk sk values shards accept",
    "value": "count sum where limit min doc",
    "access": "get batch query partition counter all scan range order page max_page project freshness rate hot_key_rate reason doc consistent accept",
    "write": "create delete update patch set add_to remove_from when requires batch versioned doc rate hot_key_rate accept",
    "require": "key when set add patch optional consume ensure counter doc",
    "volume": "per via typical max by",
}
_KEYS = {k: frozenset(v.split()) for k, v in _KEYS.items()}


class Reader:
    """Turns a decoded schema into a Design and gathers every fault on the way."""

    def __init__(self):
        self.faults: list[str] = []

    def fault(self, where: str, what: str) -> None:
        self.faults.append(f"{where}: {what}")

    def known(self, where: str, kind: str, raw: Any) -> dict:
        if not isinstance(raw, dict):
            self.fault(where, "expected a mapping")
            return {}
        for k in raw:
            if k not in _KEYS[kind]:
                self.fault(where, f"unknown key {k!r} (expected one of: {', '.join(sorted(_KEYS[kind]))})")
        return raw

    def template(self, where: str, raw: Any, fields: dict[str, Field]) -> Template:
        try:
            t = parse_template(str(raw or ""))
        except ValueError as e:
            self.fault(where, str(e))
            return Template("", ())
        for p in t.parts:
            if p.field and p.field not in fields:
                self.fault(where, f"unknown field {p.field!r}")
            elif p.field and fields[p.field].type not in KEY_TYPES:
                self.fault(where, f"{p.field} is a {fields[p.field].type}, which can't be in a key")
            elif p.lower and fields[p.field].type not in ("string", "enum", "string_set"):
                self.fault(where, f"{p.field}: only strings can be lower-cased")
        return t

    def preds(self, where: str, raw: Any, fields: dict[str, Field]) -> tuple[Pred, ...]:
        out = []
        for name, v in (raw or {}).items():
            if name not in fields:
                self.fault(where, f"unknown field {name!r}")
                continue
            negate = isinstance(v, dict) and "not" in v
            values = v["not"] if negate else v["in"] if isinstance(v, dict) and "in" in v else v
            values = tuple(values) if isinstance(values, list) else (values,)
            if len(values) == 1 and isinstance(values[0], str) and (m := re.fullmatch(r"\{(\w+)\}", values[0])):
                out.append(Pred(name, negate=negate, source=m[1]))
                continue
            f = fields[name]
            for x in values:
                fits = {"int": int, "float": (int, float), "bool": bool}.get(f.type, str)
                if not isinstance(x, fits) or f.type == "int" and isinstance(x, bool):
                    self.fault(where, f"{name}: {x!r} isn't a {f.type}")
                elif f.type == "enum" and x not in f.values and x != "":
                    self.fault(where, f"{name}: {x!r} isn't one of {', '.join(f.values)}")
            if len(set(values)) < len(values):
                self.fault(where, f"{name}: repeated value")
            if isinstance(v, dict) and "in" in v and len(values) < 2:
                self.fault(where, f"{name}: in needs two values at least")
            out.append(Pred(name, values, negate))
        return tuple(out)

    def read_field(self, where: str, name: str, raw: Any) -> Field:
        raw = {"type": raw} if isinstance(raw, str) else self.known(where, "field", raw)
        kind = raw.get("type", "string")
        if kind not in TYPES:
            self.fault(where, f"unknown type {kind!r}")
            kind = "string"
        if name in RESERVED or name.startswith("_"):
            self.fault(where, "the name is reserved")
        if kind == "enum" and not raw.get("values"):
            self.fault(where, "an enum needs values")
        if raw.get("copy_of") and raw.get("snapshot_of"):
            self.fault(where, "copy_of and snapshot_of exclude each other")
        size = None
        if "size" in raw:
            m = re.fullmatch(r"(\d+)(?:/(\d+))?", str(raw["size"]))
            if not m or m[2] and int(m[2]) < int(m[1]):
                self.fault(where, f"size {raw['size']!r} isn't p50 or p50/p99")
            else:
                size = (int(m[1]), int(m[2] or m[1]))
        return Field(name, kind, tuple(raw.get("values") or ()), bool(raw.get("required")), size, raw.get("ref", ""), raw.get("copy_of", ""), raw.get("snapshot_of", ""), self.attribute(where, raw.get("attr") or ""))

    def attribute(self, where: str, attr: Any) -> str:
        if not isinstance(attr, str) or attr in RESERVED or attr.startswith("_"):
            self.fault(where, f"attr {attr!r} can't be an attribute's name")
            return ""
        return attr

    def read_index(self, where: str, name: str, raw: Any, fields: dict[str, Field], immediate: bool) -> Index:
        raw = self.known(where, "index", raw)
        pk = self.template(where, raw.get("pk"), fields)
        sk = self.template(where, raw["sk"], fields) if raw.get("sk") else None
        sets = [f for f in pk.fields + (sk.fields if sk else []) if f in fields and fields[f].type == "string_set"]
        strategy = raw.get("strategy") or ("copy" if immediate or sets else "gsi")
        if len(set(sets)) > 1:
            self.fault(where, "only one set may be in its keys")
        if sets and strategy == "gsi":
            self.fault(where, "an index over set elements must be a copy")
        if strategy not in ("gsi", "copy"):
            self.fault(where, "strategy is gsi or copy")
        if strategy == "copy" and sk is None:
            self.fault(where, "a copy needs a sort key")
        matches = float(raw.get("matches", 1.0))
        if not 0 < matches <= 1:
            self.fault(where, "matches is a share above 0, up to 1")
        project = raw.get("project", "all")
        project = tuple(project) if isinstance(project, list) else project
        if isinstance(project, tuple):
            for f in project:
                if f not in fields:
                    self.fault(where, f"project: unknown field {f!r}")
        return Index(name, pk, sk, strategy, self.preds(where, raw.get("where"), fields), project, matches)

    def read_counter(self, where: str, name: str, raw: Any, fields: dict[str, Field]) -> Counter:
        raw = self.known(where, "counter", raw)
        values = []
        for v, r in (raw.get("values") or {}).items():
            r = {"count": True} if r == "count" else self.known(f"{where}.{v}", "value", r)
            if bool(r.get("count")) == bool(r.get("sum")):
                self.fault(f"{where}.{v}", "needs one of count and sum")
            if r.get("sum") and (r["sum"] not in fields or fields[r["sum"]].type != "int"):
                self.fault(f"{where}.{v}", "sum needs an int field")
            values.append(Value(v, r.get("sum", ""), self.preds(f"{where}.{v}", r.get("where"), fields), r.get("limit"), r.get("min")))
        shards = raw.get("shards", 1)
        if not 1 <= shards <= MAX_SHARDS:
            self.fault(where, f"shards must be 1 to {MAX_SHARDS}")
        if shards > 1 and any(v.limit is not None or v.min is not None for v in values):
            self.fault(where, "a sharded counter can't be bounded")
        if not values:
            self.fault(where, "has no values")
        return Counter(name, self.template(where, raw.get("pk"), fields), self.template(where, raw.get("sk"), fields), tuple(values), shards)

    def read_access(self, where: str, name: str, raw: Any) -> Access:
        raw = {"get": "key"} if raw == "get" else self.known(where, "access", raw)
        kinds = [k for k in ("get", "batch", "query", "partition", "counter", "scan") if k in raw]
        if len(kinds) != 1:
            self.fault(where, "needs exactly one of get, batch, query, partition, counter and scan")
            return Access(name, "get")
        kind, target = kinds[0], raw[kinds[0]]
        if isinstance(target, dict):
            kind, target = "unique", target.get("unique", "")
        if kind == "counter" and raw.get("all"):
            kind = "counter_all"
        if kind == "scan" and not raw.get("reason"):
            self.fault(where, "a scan needs a reason")
        page = raw.get("page", DEFAULT_PAGE)
        most = raw.get("max_page", max(LEAST_MAX_PAGE, page))
        if not 1 <= page <= most <= PAGE_LIMIT:
            self.fault(where, f"page must be 1 to max_page, which may be {PAGE_LIMIT} at most")
        return Access(name, kind, target if isinstance(target, str) else "key", raw.get("range", ""), raw.get("order", "asc"), page, most, tuple(raw.get("project") or ()), raw.get("freshness", ""), float(raw.get("rate", 0)), raw.get("reason", ""))

    def read_write(self, where: str, name: str, raw: Any, fields: dict[str, Field], keys: list[str]) -> Write:
        raw = {raw: True} if raw in ("create", "delete") else self.known(where, "write", raw)
        kind = next((k for k in ("create", "delete", "patch", "update") if raw.get(k)), "update" if any(k in raw for k in ("set", "add_to", "remove_from")) else "")
        if not kind or sum(bool(raw.get(k)) for k in ("create", "delete")) > 1:
            self.fault(where, "needs one of create, update, patch, set and delete")
        changed = [*(raw.get("update") or ()), *(raw.get("patch") or ())]
        named = [*changed, *(raw.get("set") or ()), *(raw.get("add_to") or ()), *(raw.get("remove_from") or ())]
        for f in named:
            if f not in fields:
                self.fault(where, f"unknown field {f!r}")
            elif kind != "create" and f in keys:
                self.fault(where, f"{f} is part of the key and can't change")
        if len(set(changed)) < len(changed):
            self.fault(where, "repeated field")
        for f, v in (raw.get("set") or {}).items():
            if f in fields and fields[f].required and v == fields[f].zero:
                self.fault(where, f"{f} is required and can't be set to nothing")
        requires = []
        for target, r in (raw.get("requires") or {}).items():
            r = self.known(f"{where}.{target}", "require", r)
            requires.append((target, r))
        return Write(
            name, kind, tuple(changed), tuple((raw.get("set") or {}).items()), tuple((raw.get("add_to") or {}).items()), tuple((raw.get("remove_from") or {}).items()),
            self.preds(where, raw.get("when"), fields), tuple(Require(t, tuple((r.get("key") or {}).items()), (), tuple((r.get("set") or {}).items()), tuple((r.get("add") or {}).items()), tuple((r.get("patch") or {}).items()), bool(r.get("optional")), bool(r.get("consume")), bool(r.get("ensure"))) for t, r in requires),
            raw.get("versioned", ""), int(raw.get("batch") or 0), float(raw.get("rate", 0)),
        )

    def read_entity(self, name: str, raw: Any) -> tuple[Entity, dict]:
        raw = self.known(name, "entity", raw)
        if not name[:1].isupper():
            self.fault(name, "an entity's name starts with a capital")
        fields = {f: self.read_field(f"{name}.{f}", f, r) for f, r in (raw.get("fields") or {}).items()}
        if not fields:
            self.fault(name, "has no fields")
        key = self.known(f"{name}.key", "key", raw.get("key") or {})
        pk, sk = (self.template(f"{name}.key.{k}", key.get(k), fields) for k in ("pk", "sk"))
        keys = list(dict.fromkeys(pk.fields + sk.fields))
        if any(fields[f].type == "string_set" for f in keys if f in fields):
            self.fault(f"{name}.key", "a set can't be in an entity's key")
        access = tuple(self.read_access(f"{name}.{a}", a, r) for a, r in (raw.get("access") or {}).items())
        immediate = {a.target for a in access if a.freshness == "immediate"}
        indexes = tuple(self.read_index(f"{name}.{i}", i, r, fields, i in immediate) for i, r in (raw.get("indexes") or {}).items())
        for ix in indexes:
            if ix.name in immediate and ix.strategy == "gsi":
                self.fault(f"{name}.{ix.name}", "a GSI can't be read with immediate freshness")
        uniques = []
        for u, r in (raw.get("unique") or {}).items():
            r = self.known(f"{name}.{u}", "unique", r)
            named = tuple(r.get("fields") or ())
            for f in named:
                if f not in fields or fields[f].type in ("string_list", "string_map", "bytes", "float"):
                    self.fault(f"{name}.{u}", f"{f!r} can't be unique")
            sets = [f for f in named if f in fields and fields[f].type == "string_set"]
            text = r.get("pk") or f"UNIQUE#{name}.{u}#" + "#".join("{%s}" % f for f in named)
            pk_u = self.template(f"{name}.{u}", text, fields)
            if set(pk_u.fields) != set(named):
                self.fault(f"{name}.{u}", "its key must hold its fields")
            uniques.append(Unique(u, named, pk_u, self.template(f"{name}.{u}", r.get("sk") or "UNIQUE", fields), sets[0] if sets else ""))
        counters = tuple(self.read_counter(f"{name}.{c}", c, r, fields) for c, r in (raw.get("counters") or {}).items())
        writes = tuple(self.read_write(f"{name}.{w}", w, r, fields, keys) for w, r in (raw.get("writes") or {}).items())
        methods = [a.name for a in access] + [w.name for w in writes]
        for m in sorted({m for m in methods if methods.count(m) > 1}):
            self.fault(name, f"two methods are called {m}")
        ttl = raw.get("ttl", "")
        if ttl and (ttl not in fields or fields[ttl].type != "time"):
            self.fault(name, "ttl must name a time field")
        v = raw.get("volume")
        volume = Volume(total=float(v)) if isinstance(v, (int, float)) else Volume(per=v.get("per", ""), typical=v.get("typical"), max=v.get("max")) if isinstance(v, dict) else Volume()
        return Entity(name, tuple(fields.values()), pk, sk, int(raw.get("version", 1)), ttl, indexes, tuple(uniques), counters, access, writes, volume), raw

    def design(self, raw: Any) -> Design:
        raw = self.known("schema", "file", raw)
        read = [self.read_entity(n, r) for n, r in (raw.get("entities") or {}).items()]
        if not read:
            self.fault("schema", "has no entities")
        entities = {e.name: e for e, _ in read}
        out = []
        for e, source in read:
            writes = []
            for w in e.writes:
                requires = []
                for r in w.requires:
                    where = f"{e.name}.{w.name}.{r.entity}"
                    if r.entity not in entities:
                        self.fault(where, "unknown entity")
                        continue
                    target = entities[r.entity]
                    if set(dict(r.key)) != set(target.key_fields):
                        self.fault(where, f"its key must give {', '.join(target.key_fields)}")
                    if r.consume and (r.set or r.add or r.patch):
                        self.fault(where, "what is consumed can't be changed too")
                    if r.ensure and (r.consume or r.optional):
                        self.fault(where, "ensure excludes consume and optional")
                    for f, _ in r.add:
                        if not target.has(f) or target.field(f).type != "int":
                            self.fault(where, f"add needs an int field, {f!r} isn't")
                    declared = source["writes"][w.name]["requires"][r.entity]
                    requires.append(replace(r, when=self.preds(where, declared.get("when"), {f.name: f for f in target.fields})))
                writes.append(replace(w, requires=tuple(requires)))
            for a in e.access:
                self.check_access(e, a)
            for f in e.fields:
                for link in (f.copy_of, f.snapshot_of):
                    if link and (link.split(".")[0] not in entities or not entities[link.split(".")[0]].has(link.split(".")[-1])):
                        self.fault(f"{e.name}.{f.name}", f"unknown source {link!r}")
                if f.ref and f.ref not in entities:
                    self.fault(f"{e.name}.{f.name}", f"unknown entity {f.ref!r}")
            out.append(replace(e, writes=tuple(writes)))
        self.separate(out)
        self.depths(out)
        table = raw.get("table") or {}
        design = Design(tuple(out), table.get("name", "items"), int(table.get("generation", 1)), table.get("ttl_attribute", "ttl"), float((raw.get("workload") or {}).get("peak", 1)))
        if self.faults:
            raise DesignError(self.faults)
        return design

    def check_access(self, e: Entity, a: Access) -> None:
        where = f"{e.name}.{a.name}"
        if a.kind == "query":
            sk = e.sk if a.target == "key" else next((i.sk for i in e.indexes if i.name == a.target), None)
            if a.target != "key" and all(i.name != a.target for i in e.indexes):
                self.fault(where, f"unknown index {a.target!r}")
            elif a.range and (sk is None or sk.first_field() != a.range):
                self.fault(where, f"range: {a.range} must be the first placeholder of the sort key")
        elif a.kind == "unique" and all(u.name != a.target for u in e.uniques):
            self.fault(where, f"unknown unique {a.target!r}")

    def separate(self, entities: list[Entity]) -> None:
        """Families whose keys could meet in one item can't be told apart."""
        for i, a in enumerate(entities):
            for b in entities[i + 1 :]:
                if may_overlap(a.pk, b.pk) and may_overlap(a.sk, b.sk):
                    self.fault(f"{a.name}, {b.name}", "their keys could be equal")

    def depths(self, entities: list[Entity]) -> None:
        parents = {e.name: e.volume.per for e in entities}
        for name in parents:
            seen, at = set(), name
            while at:
                if at in seen:
                    self.fault(name, "its volume refers to itself")
                    break
                seen.add(at)
                at = parents.get(at, "")


def read_design(raw: dict) -> Design:
    return Reader().design(raw)


def parse_design(text: str) -> Design:
    """From YAML text. Unknown and repeated keys are errors."""
    import yaml

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        keys = [loader.construct_object(k) for k, _ in node.value]
        if repeated := sorted({str(k) for k in keys if keys.count(k) > 1}):
            raise DesignError([f"line {node.start_mark.line + 1}: repeated key {repeated[0]!r}"])
        return yaml.SafeLoader.construct_mapping(loader, node, deep=True)

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    raw = yaml.load(text, Strict)  # noqa: S506
    for e in (raw or {}).get("entities", {}).values() if isinstance(raw, dict) else ():
        if isinstance(e, dict) and "volume" not in e and isinstance(e.get("estimate"), dict):  # the earlier grammar
            e["volume"] = e.pop("estimate").get("items")
    return read_design(raw)


def load_text(text: str, name: str) -> Design:
    """A design from text; faults name where it is from."""
    try:
        return parse_design(text)
    except DesignError as err:
        raise DesignError([f"{name}: {err}"]) from err


def load_design(path: str) -> Design:
    with open(path, encoding="utf-8") as f:
        return parse_design(f.read())


def nests(inner: Template, outer: Template) -> bool:
    """Whether keys of `inner` begin with a whole key of `outer`, up to a literal border."""
    a, b = inner.parts, outer.parts
    if len(a) < len(b):
        return False
    for x, y in zip(a[: len(b) - 1], b[:-1], strict=True):
        if x != y:
            return False
    x, y = a[len(b) - 1], b[-1]
    return x == y or not x.field and not y.field and x.literal.startswith(y.literal)


def parent_of(design: Design, e: Entity) -> Entity | None:
    """The entity in whose partition this one nests deepest; of those the one with most key fields."""
    found = [p for p in design.entities if p.name != e.name and p.singleton and nests(e.pk, p.pk)]
    return max(found, key=lambda p: (len(p.pk.raw), len(p.key_fields)), default=None)
