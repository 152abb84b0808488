"""Templates, predicates and refusals: driver-side pure functions."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from keystrata.model import DesignError, Field, Pred, implies, may_overlap, nests, parse_design, parse_template, prefix_collision
from keystrata.operators import analysis, cost, evolve, reads, writes
from keystrata.sources.catalog import design, entity

NATION = """
entities:
  Nation:
    fields:
      region: string
      nation: string
      name: string
      count: int
      status: {type: enum, values: [a, b]}
      at: time
      tags: string_set
    key: {pk: "T#{region}", sk: "NATION#{nation}"}
"""


def refused(extra: str, base: str = NATION) -> str:
    with pytest.raises(DesignError) as e:
        parse_design(base + extra)
    return str(e.value)


@pytest.mark.parametrize(
    ("raw", "message"),
    [("", "needs text"), ("{a}{b}", "side by side"), ("A#{", "left open"), ("A}", "left open"), ("{}", "without a field"), ("{a|upper}", "only lower is")],
)
def test_bad_templates(raw, message):
    with pytest.raises(ValueError, match=message):
        parse_template(raw)


def test_template_parts():
    t = parse_template("CLERK#{clerk}#ON#{day|lower}")
    assert t.fields == ["clerk", "day"]
    assert t.prefix == "CLERK#"
    assert not t.constant
    assert t.literals() == ["CLERK#", "#ON#", ""]
    assert t.first_field() == "clerk"


def test_overlap():
    a, b, c = (parse_template(x) for x in ("A#{x}", "AB#{x}", "A#B"))
    assert not may_overlap(a, b)
    assert may_overlap(a, c)
    assert not may_overlap(b, c)
    assert prefix_collision(parse_template("A{x}"), b)
    assert nests(parse_template("A#{x}#B#{y}"), a)
    assert not nests(a, parse_template("A#{x}#B#{y}"))


@pytest.mark.parametrize(
    ("extra", "message"),
    [
        ("    nonsense: 1\n", "unknown key 'nonsense'"),
        ("    access: {Q: {query: Nope}}\n", "unknown index"),
        ("    access: {S: {scan: true}}\n", "needs a reason"),
        ("    access: {Q: {query: key, range: name}}\n", "first placeholder"),
        ("    access: {Q: {query: key, page: 2000}}\n", "page must be"),
        ("    access: {Q: {get: key, query: key}}\n", "exactly one"),
        ("    indexes: {I: {pk: 'X#{nope}', sk: 'S'}}\n", "unknown field 'nope'"),
        ("    indexes: {I: {pk: 'X#{tags}', strategy: gsi}}\n", "must be a copy"),
        ("    indexes: {I: {pk: 'X', strategy: copy}}\n", "needs a sort key"),
        ("    indexes: {I: {pk: 'X', sk: '{count|lower}'}}\n", "only strings"),
        ("    counters: {C: {pk: X, sk: Y, values: {v: {sum: name}}}}\n", "sum needs an int"),
        ("    counters: {C: {pk: X, sk: Y, values: {v: {}}}}\n", "one of count and sum"),
        ("    counters: {C: {pk: X, sk: Y, shards: 101, values: {v: count}}}\n", "shards must be"),
        ("    counters: {C: {pk: X, sk: Y, shards: 2, values: {v: {count: true, limit: 3}}}}\n", "can't be bounded"),
        ("    writes: {U: {update: [nation]}}\n", "part of the key"),
        ("    writes: {U: {update: [name, name]}}\n", "repeated field"),
        ("    writes: {U: {set: {status: c}, when: {status: z}}}\n", "isn't one of"),
        ("    writes: {U: {set: {status: a}, requires: {Nope: {key: {}}}}}\n", "unknown entity"),
        ("    volume: {per: Nation, typical: 2}\n", "refers to itself"),
        ("    ttl: name\n", "must name a time field"),
    ],
)
def test_refusals(extra, message):
    assert message in refused(extra)


def test_every_fault_is_told():
    text = refused("    nonsense: 1\n    ttl: name\n")
    assert "nonsense" in text
    assert "ttl" in text


def test_repeated_yaml_key():
    with pytest.raises(DesignError, match="repeated key"):
        parse_design("entities: {}\nentities: {}\n")


def test_indistinguishable_families():
    other = "  Other:\n    fields: {a: string, b: string}\n    key: {pk: 'T#{a}', sk: 'NATION#{b}'}\n"
    assert "keys could be equal" in refused(other)


def test_earlier_grammar():
    d = parse_design(NATION + "    estimate: {items: 12}\n")
    assert d.entity("Nation").volume.total == 12


def test_implication():
    f = Field("s", "enum", ("a", "b", "c"))
    assert implies((Pred("s", ("a",)),), Pred("s", ("a", "b")), f) is True
    assert implies((Pred("s", ("a",)),), Pred("s", ("b",)), f) is False
    assert implies((Pred("s", ("a", "b")),), Pred("s", ("b",)), f) is None
    assert implies((), Pred("s", ("b",)), f) is None
    assert Pred("s", ("a",), negate=True).allowed(f) == ("b", "c", "")


def test_index_is_a_copy_when_read_at_once():
    assert entity("Order").index("Open").strategy == "copy"
    assert entity("Order").index("ByUrgency").strategy == "gsi"


def test_sizes_by_hand():
    """An item with an index, by the documented formulas."""
    d = parse_design("""
entities:
  Company:
    fields:
      companyId: string
      name: {type: string, size: 20/80, required: true}
      code: {type: string, size: 12/40}
      openDate: time
    key: {pk: "COM#{companyId}", sk: COMPANY}
    indexes:
      All: {pk: COMPANIES, sk: "{name|lower}#{companyId}", project: [code, openDate]}
    volume: 2000
""")
    assert cost.item_size(d.entity("Company")) == (298, 585)
    assert cost.write_units(1025) == 2
    assert cost.read_units(4097) == 1.0
    assert cost.read_units(10, True) == 1.0


def test_months():
    assert round(cost.monthly(44.65, 1, cost.PRICE_READ), 2) == 14.47


def test_lifecycle_of_orders():
    assert ("O", "F") in analysis.declared_lifecycle(entity("Order"), "o_orderstatus")
    assert ("", "O") in analysis.declared_lifecycle(entity("Order"), "o_orderstatus")


def test_findings_are_by_severity():
    ranks = [analysis.RANKS[f.severity] for f in analysis.findings(design())]
    assert ranks == sorted(ranks)
    assert analysis.parse_size("64KB") == 65536


def test_cursor_scope_and_rotation():
    a = entity("Order").reads("History")
    s = reads.scope("shop", a, {"o_custkey": 1})
    c = reads.encode_cursor(s, {"k": 5}, b"old")
    assert reads.decode_cursor(c, s, (b"new", b"old")) == {"k": 5}
    with pytest.raises(reads.CursorError, match="another read"):
        reads.decode_cursor(c, reads.scope("shop", a, {"o_custkey": 2}), (b"old",))
    with pytest.raises(reads.CursorError, match="signed"):
        reads.decode_cursor(c, s, (b"new",))
    with pytest.raises(reads.CursorError, match="can't be read"):
        reads.decode_cursor("!!", s)


@given(st.dictionaries(st.text(), st.integers()))
def test_fingerprint_ignores_order(x):
    assert evolve.fingerprint(x) == evolve.fingerprint(dict(reversed(list(x.items()))))


def test_versions():
    from dataclasses import replace

    e = entity("Supplier")
    assert evolve.next_version(evolve.shape(e), e) == ("unchanged", [])
    assert evolve.next_version(evolve.shape(e), replace(e, sk=parse_template("S")))[0] == "new_generation"
    assert evolve.next_version(evolve.shape(e), replace(e, version=2, fields=(*e.fields, Field("x"))))[0] == "new_version"
    assert evolve.conversion_gaps(e, replace(e, fields=(*e.fields, Field("x", required=True)))) == ["x"]


def test_retries_and_batches():
    assert writes.waits([1.0] * 8) == [0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.25]
    assert writes.batch_size(8) == 12
    assert evolve.conflict_key("a", "b") == "1#ab"
    assert len(evolve.conflict_key("a" * 2000, "b")) == 64
