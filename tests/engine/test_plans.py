"""The planner, documents and the command line."""

import json

from keystrata.__main__ import main
from keystrata.model import Pred, Write
from keystrata.plans import document, planner
from keystrata.sources.catalog import design, entity

SCHEMA = """
table: {name: shipping, generation: 1}
entities:
  Line:
    fields:
      orderkey: int
      number: int
      flag: {type: enum, values: [N, A, R]}
    key: {pk: "O#{orderkey}#L#{number}", sk: LINE}
    counters:
      Flags:
        pk: "O#{orderkey}"
        sk: FLAGS
        values: {none: {count: true, where: {flag: N}}, returned: {count: true, where: {flag: R}}}
    writes:
      Ship: {create: true, set: {flag: N}}
      Return: {set: {flag: R}, when: {flag: N}}
      Mark: {update: [flag]}
"""


def test_write_without_a_read_when_the_change_is_known(tmp_path):
    from keystrata.model import parse_design

    e = parse_design(SCHEMA).entity("Line")
    assert planner.write_shape(e, e.write("Return")) == "read_free"
    assert planner.write_shape(e, e.write("Mark")) == "read_first"
    assert planner.write_shape(e, e.write("Ship")) == "put"


def test_members():
    e = entity("Order")
    ix = e.index("Open")
    assert planner.members(e, ix, e.write("Place")) == (False, True)
    assert planner.members(e, ix, e.write("Close")) == (True, False)
    assert planner.members(e, ix, Write("X", "update", set=(("o_totalprice", 1.0),), when=(Pred("o_orderstatus", ("O",)),))) == (True, True)


def test_documents():
    s = document.snapshot(design())
    assert json.loads(json.dumps(s))["entities"]["Order"]["growth"] == "bounded"
    text = document.markdown(design())
    assert "## Order" in text
    assert "erDiagram" in text
    assert json.loads(document.terraform(design()))["resource"]
    assert json.loads(document.create_request(design()))["TableName"] == "shop-g1"
    assert document.human(1536) == "1.5 KB"
    assert document.plural(1, "item") == "1 item"
    assert document.plural(2, "item") == "2 items"


def test_lock(tmp_path):
    path = str(tmp_path / "lock")
    first = document.write_lock(path, design())
    assert any("is new" in n for n in first)
    assert document.write_lock(path, design()) == []
    from dataclasses import replace

    from keystrata.model import parse_template

    e = entity("Supplier")
    moved = replace(design(), entities=tuple(replace(x, sk=parse_template("S")) if x is e else x for x in design().entities))
    assert any("raise the table's generation" in n for n in document.write_lock(path, moved))
    assert document.write_lock(path, replace(moved, generation=2))
    assert document.read_lock(path)["generation"] == 2


def test_command_line(tmp_path, capsys):
    path = tmp_path / "s.yaml"
    path.write_text(SCHEMA)
    for verb in ("check", "document", "snapshot", "terraform", "request", "lock"):
        assert main([verb, str(path)]) == 0
    assert main(["check", str(tmp_path / "none.yaml")]) == 1
    assert main(["nonsense"]) == 2
    path.write_text("entities: {}\n")
    assert main(["check", str(path)]) == 1
    assert "no entities" in capsys.readouterr().err
