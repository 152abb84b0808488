"""Copying to a new generation: conflicts by kind, holders that give way, segments and checkpoints; commits of several entities."""

import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from keystrata.model import Counter, Entity, Field, Unique, Value, parse_template
from keystrata.operators import evolve, migrate
from keystrata.sources.catalog import entity, rows
from keystrata.sources.store import CommitConflict, Store, transact

SF = "/root/testdata/sf0.001"
T = parse_template
OLD = Entity("Berth", (Field("id", "int"), Field("pier"), Field("ship")), T("OLD#{id}"), T("B"))
NEW = Entity(
    "Berth",
    (Field("id", "int"), Field("pier", required=True), Field("ship")),
    T("B#{pier}"),
    T("N#{id}"),
    uniques=(Unique("Ship", ("ship",), T("UNIQUE#S#{ship}"), T("UNIQUE")),),
    counters=(Counter("PerPier", T("PIER#{pier}"), T("COUNT"), (Value("berths", limit=3),)),),
)
KIND = "id long, pier string, ship string, _rev long"


class World:
    """A source that tests change, and copies as Parquet folders."""

    def __init__(self, spark, folder, data, **kw):
        self.spark, self.folder, self.data, self.n, self.kept = spark, folder, data, 0, None
        self.save(evolve.converted(self.read(), OLD, NEW).limit(0))
        self.m = self.start(**kw)

    def read(self):
        return self.spark.createDataFrame(self.data, KIND)

    def load(self):
        return self.spark.read.parquet(f"{self.folder}/{self.n}")

    def save(self, df):
        df.write.parquet(f"{self.folder}/{self.n + 1}")
        self.n += 1

    def keep(self, text):
        self.kept = text

    def start(self, **kw):
        return migrate.Migration(OLD, NEW, self.read, self.load, self.save, self.keep, self.kept, **{"segments": 4, **kw})

    def copies(self):
        return sorted((r.id, r.pier, r.ship, r.src_rev) for r in self.load().collect())


def test_conflicts_have_kinds(spark, tmp_path):
    data = [(1, "a", "x", 1), (2, "a", "x", 1), (3, None, "y", 1), (4, "b" * 3000, "z", 1), (5, "c", "v", 1)]
    data += [(i, "d", f"s{i}", 1) for i in range(10, 15)]
    w = World(spark, str(tmp_path), data, segments=1)
    assert w.m.bulk() == []
    bad = {r.src_pk: r.conflict for r in w.m.finish().collect()}
    number = lambda i: f"OLD#{i:019d}"
    assert bad == {number(2): "claim_taken", number(3): "required", number(4): "key_too_long", number(13): "limit", number(14): "limit"}
    assert [c[0] for c in w.copies()] == [1, 5, 10, 11, 12]
    assert not w.m.progress.finished


def test_two_sources_of_one_key(spark, tmp_path):
    new = replace(NEW, sk=T("N"), uniques=(), counters=())
    source = evolve.converted(spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 1), (3, "b", "z", 1)], KIND), OLD, new)
    assert {(r.src_pk[-1], r.conflict) for r in migrate.conflicts(source, source.limit(0), new).collect()} == {("1", "same_key"), ("2", "same_key")}
    there = source.filter("id = 3").withColumn("src_pk", F.lit("elsewhere"))
    assert {(r.src_pk[-1], r.conflict) for r in migrate.conflicts(source.filter("id = 3"), there, new).collect()} == {("3", "same_key")}


def test_a_conflict_is_tried_again_after_its_holder_went(spark, tmp_path):
    w = World(spark, str(tmp_path), [(1, "a", "x", 1), (2, "b", "x", 1)])
    w.m.bulk()
    assert [c[0] for c in w.copies()] == [1]
    w.data = [(2, "b", "x", 1)]
    assert [p["removed"] for p in w.m.catch_up()] == [1, 0]
    assert w.copies() == [(2, "b", "x", 1)]
    assert w.m.finish().count() == 0
    assert w.m.progress.finished


def test_a_stale_holder_gives_way(spark, tmp_path):
    """Two ships swap berths between two passes: the copies that hold the names are older than both rows."""
    w = World(spark, str(tmp_path), [(1, "a", "x", 1), (2, "b", "y", 1)])
    w.m.bulk()
    w.data = [(1, "a", "y", 2), (2, "b", "x", 2)]
    source = w.m.source()
    assert migrate.displaced(source, w.load(), NEW).count() == 2
    passes = w.m.catch_up()
    assert passes[0]["conflicts"] == 0
    assert w.copies() == [(1, "a", "y", 2), (2, "b", "x", 2)]


def test_a_run_goes_on_where_another_was_lost(spark, tmp_path):
    data = [(i, f"p{i}", f"s{i}", 1) for i in range(40)]
    w = World(spark, str(tmp_path), data)
    left = w.m.bulk(most_segments=2)
    assert len(left) == 2
    some = len(w.copies())
    assert 0 < some < 40
    with pytest.raises(ValueError, match="segments"):
        w.m.finish()
    again = w.start()
    assert again.progress.done == w.m.progress.done
    assert again.bulk() == []
    assert len(w.copies()) == 40
    assert again.progress.copied == 40
    assert again.catch_up() == [{"copied": 0, "removed": 0, "conflicts": 0}]
    assert again.finish().count() == 0


def test_record_keys(spark):
    pairs = [("OLD#1", "B"), ("x" * 1500, "B"), ("é", "ü")]
    df = spark.createDataFrame(pairs, "src_pk string, src_sk string")
    got = [r.k for r in df.select(migrate.record_key("src_pk", "src_sk").alias("k")).collect()]
    assert got == [evolve.conflict_key(*p) for p in pairs]


def test_commits_of_several_entities(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"))
    frame = lambda n: spark.range(n).withColumnRenamed("id", "a")
    store.commit_all({"A": frame(1), "B": frame(2)}, {"A": None, "B": None})
    seen = store.versions("A", "B", "C")
    assert seen == {"A": "A.v1", "B": "B.v1", "C": None}
    store.commit("C", frame(5), None)
    store.commit_all({"A": frame(3)}, {"A": seen["A"], "B": seen["B"]})  # C moved, which this neither read nor writes
    with pytest.raises(CommitConflict, match="A"):
        store.commit_all({"B": frame(9), "C": frame(9)}, seen | {"C": "C.v1"})
    assert [store.read(e).count() for e in "ABC"] == [3, 2, 5]
    assert store.clean(keep=1, age_seconds=0) == 2 + 3  # two states; the first A, the refused B and C
    assert [store.read(e).count() for e in "ABC"] == [3, 2, 5]


def test_races_are_worked_out_again(spark, tmp_path):
    """Takers move one unit from stock to their own account, both entities at once: none is lost, none is made."""
    store = Store(spark, str(tmp_path / "t"))
    store.commit_all({"Stock": spark.createDataFrame([(6,)], "n long"), "Taken": spark.createDataFrame([], "who long")}, {})

    def taker(i):
        def work(now):
            n = now["Stock"].first()["n"]
            return {"Stock": spark.createDataFrame([(n - 1,)], "n long"), "Taken": now["Taken"].unionByName(spark.createDataFrame([(i,)], "who long"))}

        transact(store, ["Stock", "Taken"], work, [0.05 * (i + 1)] * 12)

    threads = [threading.Thread(target=taker, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.read("Stock").first()["n"] == 2
    assert sorted(r.who for r in store.read("Taken").collect()) == [0, 1, 2, 3]


def test_orders_move_to_a_key_of_their_own(spark, tmp_path):
    """All orders of the example store, under a key that none of them shares."""
    old = entity("Order")
    new = replace(old, version=2, pk=T("O#{o_orderkey}"), sk=T("ORDER"), indexes=(), counters=())
    o = rows(spark, SF, "Order").withColumn("_rev", F.lit(1).cast("bigint"))
    at = [0]
    evolve.converted(o, old, new).limit(0).write.parquet(f"{tmp_path}/0")

    def save(df):
        df.write.parquet(f"{tmp_path}/{at[0] + 1}")
        at[0] += 1

    m = migrate.Migration(old, new, lambda: o, lambda: spark.read.parquet(f"{tmp_path}/{at[0]}"), save, lambda _: None, segments=3)
    assert m.bulk() == []
    assert m.finish().count() == 0
    assert m.progress.finished
    assert spark.read.parquet(f"{tmp_path}/{at[0]}").select(*o.columns[:5]).exceptAll(o.select(*o.columns[:5])).count() == 0
