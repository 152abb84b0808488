"""Policies, differences of designs, attributes' names, and schemas at a revision."""

import subprocess
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from keystrata import __main__ as cli
from keystrata.functions import keys as K
from keystrata.model import DesignError, parse_design, parse_template
from keystrata.operators import analysis, cost, evolve, policy, reads
from keystrata.plans import changes
from keystrata.sources.catalog import design

SCHEMA = """
version: 1
entities:
  Parcel:
    fields:
      code: { type: string, attr: c, size: 12/20 }
      depot: string
      state: { type: enum, values: [here, sent] }
    key: { pk: "P#{code}", sk: PARCEL }
    access:
      Get: { get: key, rate: 5 }
    writes:
      Add: { create: true, rate: 2 }
      Send: { set: { state: sent }, when: { state: here } }
    volume: 1000
"""


def test_limits_and_requirements():
    d = design()
    assert not [f for f in policy.check(d) if f.rule in ("volume-missing", "freshness-unstated", "rate-missing")]
    p = policy.read_policy("fail_on: warning\nrules: {scan: off, project-all: error, sparse-index: note}\nlimits: {item_size: 1KB, gsis: 1, transaction_items: 1, indexes_per_entity: 1, partition_size: 10KB}\nrequire: {rates: true, volumes: true, freshness: true}")
    found = policy.check(d, p)
    rules = {f.rule for f in found}
    assert {"item-size-limit", "gsi-limit", "transaction-items-limit", "index-limit", "partition-size-limit", "rate-missing", "volume-missing", "freshness-unstated"} <= rules
    assert "scan" not in rules
    assert all(f.severity == "note" for f in found if f.rule == "sparse-index")
    assert {f.subject for f in found if f.rule == "volume-missing"} == {"Event", "Turn"}
    assert [analysis.RANKS[f.severity] for f in found] == sorted(analysis.RANKS[f.severity] for f in found)
    assert policy.fails(found, p)
    assert not policy.fails(found, replace(p, fail_on="error"))
    roomy = policy.read_policy({"limits": {"item_size": "1MB", "gsis": 20, "transaction_items": 100, "indexes_per_entity": 9, "partition_size": "1TB"}})
    assert not policy.own_findings(d, roomy)


@pytest.mark.parametrize("text", ["fail_on: fatal", "rules: {no-such: error}", "rules: {item-too-large: off}", "rules: {scan: loud}", "limits: {items: 3}", "limits: {item_size: big}", "limits: {gsis: 0}", "require: {tests: true}", "other: 1", "[1]"])
def test_bad_policies(text):
    with pytest.raises(DesignError):
        policy.read_policy(text)


def test_counters_by_their_busiest_key():
    d = design()
    numbers = cost.counts(d)
    order = d.entity("Order")
    assert analysis.busiest_share(d, order, order.counter("StatusTotals"), numbers) == 1 / 3
    assert analysis.busiest_share(d, order, order.counter("CustomerOrders"), numbers) == 30 / 150_000
    event = d.entity("Event")
    assert analysis.busiest_share(d, event, event.counter("Types"), numbers) is None


def test_attributes_names(spark):
    e = parse_design(SCHEMA).entity("Parcel")
    df = spark.createDataFrame([("x1", "north", "here")], "code string, depot string, state string")
    items = reads.items(df, e)
    assert items.columns == ["PK", "SK", "_t", "c", "depot", "state"]
    assert reads.fields_of(items, e).collect() == df.collect()
    longer = parse_design(SCHEMA.replace("attr: c,", "")).entity("Parcel")
    assert cost.item_size(longer)[0] - cost.item_size(e)[0] == 3
    state, notes = evolve.next_version(evolve.shape(e), replace(longer, version=2))
    assert (state, notes) == ("new_generation", ["fields code changed: needs a new generation"])
    reused = parse_design(SCHEMA.replace("depot: string", "depot: { type: int, attr: d }")).entity("Parcel")
    history = evolve.attribute_history([evolve.shape(e), evolve.shape(replace(reused, version=2)), evolve.shape(replace(e, version=3, fields=(*e.fields, replace(e.fields[0], name="more", attr="d"))))], [1, 1, 1])
    found = evolve.reused_attributes(spark.createDataFrame(history, "entity string, generation int, version int, attribute string, type string")).collect()
    assert [(r.attribute, r.type, r.type_b) for r in found] == [("d", "int", "string")]
    with pytest.raises(DesignError):
        parse_design(SCHEMA.replace("attr: c,", "attr: PK,"))


def test_sections_of_a_difference():
    a = parse_design(SCHEMA)
    b = parse_design(SCHEMA.replace("volume: 1000", "volume: 5000").replace("rate: 2", "rate: 2.1").replace("depot: string", "depot: { type: string, required: true }\n      note: string").replace("Send: {", "Recall: delete\n      Send: {"))
    rows = changes.diff(a, b)
    assert ("Workload", "Parcel items", "changed", "1000", "5000") in rows
    assert not any(s == "Parcel.Add a second" for _, s, *_ in rows)  # moved by less than a tenth
    assert {(s, x, c) for s, x, c, *_ in rows} >= {("Fields", "Parcel.note", "added"), ("Fields", "Parcel.depot", "changed"), ("Writes", "Parcel.Recall", "added"), ("Guarantees", "Parcel: depot is never empty", "added")}
    assert [changes.SECTIONS.index(r[0]) for r in rows] == sorted(changes.SECTIONS.index(r[0]) for r in rows)
    assert changes.diff(a, a) == []
    assert changes.text(a, a) == ""
    assert "Parcel: fields depot changed: needs a new generation" in changes.text(a, b)
    assert {c for *_, c, _, _ in changes.diff(None, a)} == {"added"}


def test_design_at_a_revision(tmp_path, capsys):
    path = tmp_path / "s.yaml"
    git = lambda *x: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=a", "-c", "user.email=a@b", *x], check=True, capture_output=True)
    git("init", "-q")
    path.write_text(SCHEMA)
    git("add", ".")
    git("commit", "-qm", "first")
    path.write_text(SCHEMA.replace("volume: 1000", "volume: 9000"))
    assert changes.at_revision(str(path), "HEAD") == parse_design(SCHEMA)
    assert cli.main(["diff", f"HEAD:{path}", str(path)]) == 0
    assert "Parcel items: changed, 1000 to 9000" in capsys.readouterr().out
    rules = tmp_path / "p.yaml"
    rules.write_text("fail_on: warning\nlimits: {item_size: 1B}\n")
    assert cli.main(["check", "-policy", str(rules), str(path)]) == 1
    assert "item-size-limit" in capsys.readouterr().out
    assert cli.main(["check", str(path)]) == 0
    assert cli.main(["diff", "nowhere:" + str(path), str(path)]) == 1
    assert cli.main(["check"]) == 2


def test_keys_that_do_not_tell_cases_apart_compose(spark):
    """A letter with its accent, and the same as one character, make one key."""
    df = spark.createDataFrame([("CafÉ",), ("Café",), (None,), ("plain",)], "t string")
    got = [r.k for r in df.select(K.lowered(F.col("t")).alias("k")).collect()]
    assert got == ["café", "café", None, "plain"]
    listed = spark.createDataFrame([(["É", "x"],), (None,)], "t array<string>")
    assert [r.k for r in listed.select(K.lowered_elements(F.col("t")).alias("k")).collect()] == [["é", "x"], None]


def test_hash_of_keys(spark):
    def fnv(data):
        h = 2166136261
        for b in data:
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    texts = ["", "a", "C#0001\0ORDER#é", "日本", "\0\0", "x" * 300]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(K.fnv1a(F.col("t")).alias("h")).collect()]
    assert got == [fnv(t.encode()) for t in texts]


def test_template_of_a_bad_schema():
    with pytest.raises(ValueError, match="side by side"):
        parse_template("A#{a}{b}")
