"""One query for each operator of the engine, over the example store; `SQL` has the same answers in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions import keys as K
from keystrata.functions.preds import holds, live
from keystrata.model import Counter, Entity, Field, Index, Pred, Require, Unique, Value, Write, parse_template
from keystrata.operators import analysis, cost, derive, evolve, migrate, reads, writes
from keystrata.plans import document, planner
from keystrata.sources.catalog import SCHEMA, design, entity, rows, table
from keystrata.sources.store import physical
from keystrata.streaming import maintain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

NOW = 1_706_000_000
KEY = "'C#' || printf('%019d', {0})"
TIME = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') || '000Z'"
ORDER_SK = f"('ORDER#' || {TIME.format('o_orderdate')} || '#' || printf('%019d', o_orderkey))"
URGENCY = "nullif(o_orderpriority, '5-LOW')"
NUMBER = "printf('%019d', {0})"
#: Every item of the table: rendered keys and type.
ITEMS = f"""SELECT {KEY.format('c_custkey')} AS PK, 'CUSTOMER' AS SK, 'Customer' AS t FROM customer
UNION ALL SELECT {KEY.format('o_custkey')}, {ORDER_SK}, 'Order' FROM orders
UNION ALL SELECT 'P#' || {NUMBER.format('p_partkey')}, 'PART', 'Part' FROM part
UNION ALL SELECT 'S#' || {NUMBER.format('s_suppkey')}, 'SUPPLIER', 'Supplier' FROM supplier
UNION ALL SELECT 'O#' || {NUMBER.format('l_orderkey')}, 'LINE#' || {NUMBER.format('l_linenumber')} || '#' || {NUMBER.format('l_partkey')} || '#' || {NUMBER.format('l_suppkey')}, 'Line' FROM lineitem
UNION ALL SELECT 'U#' || {NUMBER.format('user_id')}, 'EV#' || {TIME.format('ts')} || '#' || {NUMBER.format('event_id')}, 'Event' FROM events
UNION ALL SELECT 'CONV#' || {NUMBER.format('conv_id')}, 'TURN#' || {NUMBER.format('turn')}, 'Turn' FROM conversations"""
#: 32-bit FNV-1a of an ASCII text.
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


def _raw() -> str:
    """The example store's schema, as it is written, as tables: what SQL works answers out of."""
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, bool | int | float) else "'" + str(x).replace("'", "''") + "'"
    table_ = lambda name, columns, rows_: f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows_)})"
    es, fs, us, ws, rs, ts = [], [], [], [], [], []
    for i, (name, e) in enumerate(SCHEMA["entities"].items()):
        v = e.get("volume", {})
        v = v if isinstance(v, dict) else {"total": v}
        es.append((i, name, e["key"]["pk"], e["key"]["sk"], e.get("ttl"), v.get("total"), v.get("per"), v.get("typical")))
        for f, x in e["fields"].items():
            x = {"type": x} if isinstance(x, str) else x
            fs.append((name, f, x["type"], bool(x.get("required")), x.get("ref")))
        us += [(name, u, f) for u, x in e.get("unique", {}).items() for f in x["fields"]]
        ts += [(name, n, "table" if x.get("strategy") == "copy" else n, x["pk"]) for n, x in e.get("indexes", {}).items()]
        ts += [(name, n, "table", x["pk"]) for n, x in e.get("counters", {}).items()]
        for w, x in e.get("writes", {}).items():
            x = {x: True} if isinstance(x, str) else x
            ws.append((name, w, "create" if "create" in x else "delete" if "delete" in x else "update"))
            rs += [(name, w, target) for target in x.get("requires", {})]
    parts = (("e", "i, entity, pk, sk, ttl, total, per, typical", es), ("f", "entity, field, type, required, ref", fs), ("u", "entity, name, field", us), ("w", "entity, write, kind", ws), ("r", "entity, write, target", rs), ("t", "entity, name, space, pk", ts))
    return "WITH RECURSIVE " + ",\n".join(table_(*x) for x in parts)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def all_items(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for e in design().entities:
        part = reads.items(rows(spark, d, e.name), e).select("PK", "SK", "_t")
        out = part if out is None else out.unionByName(part)
    return out


def tagged(spark: SparkSession, d: str) -> tuple[Entity, DataFrame]:
    """Documents with the set of their words: an entity with a claim, an index and a counter for every element."""
    t = parse_template
    e = Entity(
        "Doc",
        (Field("doc_id", "int"), Field("source"), Field("tags", "string_set")),
        t("D#{doc_id}"),
        t("DOC"),
        indexes=(Index("ByWord", t("W#{tags}"), t("D#{doc_id}")),),
        uniques=(Unique("Word", ("tags",), t("UNIQUE#W#{tags}"), t("UNIQUE"), element="tags"),),
        counters=(Counter("Words", t("S#{source}"), t("W#{tags}"), (Value("docs"),)),),
    )
    return e, table(spark, d, "documents").select("doc_id", "source", F.array_distinct(F.split("text", " ")).alias("tags"))


def money(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("decimal(28,2)")


# --- keys -------------------------------------------------------------------------------------------------------------


@query(f"SELECT o_orderkey, {KEY.format('o_custkey')} AS PK, {ORDER_SK} AS SK FROM orders")
def k2_render_keys(spark, d):
    e = entity("Order")
    return rows(spark, d, "Order").select("o_orderkey", *K.item_key(e))


@query("SELECT o_orderkey, '-' || lpad(CAST(9223372036854775808::HUGEINT - o_orderkey - 1 AS VARCHAR), 19, '0') AS enc FROM orders")
def k8_negative_ints(spark, d):
    return table(spark, d, "orders").select("o_orderkey", K.fmt_int(-F.col("o_orderkey") - 1).alias("enc"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS t, CASE WHEN value > 0 THEN 'true' ELSE 'false' END AS b, lower(event_type) AS l FROM events")
def k8_time_bool_lower(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", K.fmt_time(F.col("ts")).alias("t"), (F.col("value") > 0).cast("string").alias("b"), F.lower("event_type").alias("l"))


@query(f"SELECT o_orderkey, {TIME.format('o_orderdate')} AS date_text, printf('%019d', o_orderkey) AS key_text FROM orders")
def k7_split_key(spark, d):
    e = entity("Order")
    parts = K.split(K.render(e.sk, e), e.sk)
    return rows(spark, d, "Order").select("o_orderkey", parts["o_orderdate"].alias("date_text"), parts["o_orderkey"].alias("key_text"))


@query(f"SELECT c_custkey, CAST({FNV.format('c_name')} % 8 AS INT) AS shard FROM customer")
def k9_shard(spark, d):
    return table(spark, d, "customer").select("c_custkey", (K.fnv1a(F.col("c_name")) % 8).cast("int").alias("shard"))


@query("SELECT s AS shard, 'C#S' || s AS pk FROM range(0, 8) t(s)")
def k9_shard_list(spark, d):
    return spark.range(8).select(F.col("id").alias("shard"), K.shard_key(F.lit("C"), F.col("id"), 8).alias("pk"))


@query(f"SELECT CAST(count(DISTINCT t) AS INT) AS PK_kinds FROM ({ITEMS}) GROUP BY PK, SK HAVING count(DISTINCT t) > 1")
def k6_key_collisions(spark, d):
    """Keys that items of several kinds have, over the whole table."""
    return analysis.key_collisions(all_items(spark, d)).select(F.col("kinds").cast("int").alias("PK_kinds"))


@query(_raw() + "SELECT entity, pk, sk, len(list_filter(regexp_extract_all(sk, '[{]([a-z_]+)', 1), lambda x: NOT list_contains(regexp_extract_all(pk, '[{]([a-z_]+)', 1), x))) = 0 AS singleton FROM e")
def k1_templates(spark, d):
    return spark.createDataFrame([(e.name, e.pk.raw, e.sk.raw, e.singleton) for e in design().entities], "entity string, pk string, sk string, singleton boolean")


@query("SELECT o_orderkey, strlen('C#' || printf('%019d', o_custkey)) <= 2048 AS ok FROM orders")
def p19_key_length(spark, d):
    e = entity("Order")
    return rows(spark, d, "Order").select("o_orderkey", K.lengths_ok(K.render(e.pk, e), K.render(e.sk, e)).alias("ok"))


@query("SELECT p_partkey, NOT contains(p_name, ' ') AS ok FROM part")
def p18_separators(spark, d):
    e = Entity("X", (Field("p_name"), Field("p_partkey", "int")), parse_template("X"), parse_template("{p_name} {p_partkey}"))
    return table(spark, d, "part").select("p_partkey", K.separators_ok(e).alias("ok"))


# --- predicates and scans ---------------------------------------------------------------------------------------------


@query(f"SELECT coalesce({URGENCY}, '') = '1-URGENT' AS eq, coalesce({URGENCY}, '') <> '1-URGENT' AS ne, coalesce({URGENCY}, '') IN ('', '2-HIGH') AS is_in, coalesce({URGENCY}, '') = '' AS zero, count(*) AS n FROM orders GROUP BY ALL")
def p1_p3_predicates(spark, d):
    e = entity("Order")
    of = lambda *v, negate=False: holds(e, (Pred("o_urgency", v, negate),))
    flags = [of("1-URGENT").alias("eq"), of("1-URGENT", negate=True).alias("ne"), of("", "2-HIGH").alias("is_in"), of("").alias("zero")]
    return rows(spark, d, "Order").groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {URGENCY} IS NOT NULL AND o_orderstatus = 'O' AS inside, count(*) AS n FROM orders GROUP BY ALL")
def p8_p9_presence(spark, d):
    e = entity("Order")
    ix = e.index("ByUrgency")
    cond = K.present(e, ix.pk, ix.sk) & holds(e, (Pred("o_orderstatus", ("O",)),))
    return rows(spark, d, "Order").groupBy(cond.alias("inside")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, user_id FROM events WHERE floor(epoch(ts))::BIGINT + 604800 > {NOW}")
def p11_ttl_live(spark, d):
    e = entity("Event")
    return rows(spark, d, "Event").filter(live(e.ttl, F.lit(NOW))).select("event_id", "user_id")


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus FROM orders")
def p13_projection(spark, d):
    e = entity("Order")
    names = [f.name for f in e.fields if f.name in {*e.key_fields, "o_orderstatus"}]
    return rows(spark, d, "Order").select(*names)


@query(f"SELECT p_brand AS k1, NULL AS k2, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT NULL, {URGENCY}, count(*) FROM orders WHERE {URGENCY} IS NOT NULL GROUP BY 2")
def p15_shared_projection(spark, d):
    a = reads.index_view(rows(spark, d, "Part"), entity("Part"), "ByBrand").select(F.col("p_brand").alias("k1"))
    b = reads.index_view(rows(spark, d, "Order"), entity("Order"), "ByUrgency").select(F.col("o_urgency").alias("k2"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 'x' AS added FROM events")
def p16_keep_unknown(spark, d):
    kept = writes.overlay(F.from_json("props", "map<string,string>"), F.create_map(F.lit("added"), F.lit("x")))
    return table(spark, d, "events").select("event_id", kept["k"].alias("k"), kept["added"].alias("added"))


@query("SELECT c_custkey, c_name IS NULL OR c_name = '' AS bad FROM customer")
def p17_required(spark, d):
    return rows(spark, d, "Customer").select("c_custkey", writes.missing_required(entity("Customer")).alias("bad"))


@query("SELECT s_suppkey, s_name FROM supplier")
def s5_scan_entity(spark, d):
    return reads.scan(rows(spark, d, "Supplier"), entity("Supplier")).select("s_suppkey", "s_name")


@query(f"SELECT PK, SK FROM (SELECT *, row_number() OVER (ORDER BY PK, SK) AS r FROM ({ITEMS})) WHERE r > 500 AND r <= 1500 AND t = 'Customer'")
def s5_scan_page(spark, d):
    """A page of a thousand rows of the table after the first five hundred, in key order, and of it those of one kind."""
    everything = all_items(spark, d)
    return reads.scan_page(everything, "Customer", reads.page_end(everything, None, 500), 1000).select("PK", "SK")


@query("SELECT CAST(('0x' || substr(sha256('CONV#' || printf('%019d', conv_id)), 1, 8))::UBIGINT % 8 AS INT) AS segment, count(*) AS n FROM conversations GROUP BY 1 HAVING segment NOT IN (2, 5)")
def s6_segment_scan(spark, d):
    """Eight segments of a scan, of which an earlier run has finished two."""
    found = reads.scan_segments(rows(spark, d, "Turn"), entity("Turn"), 8, done=(2, 5))
    return found.groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def s7_table_sink(spark, d):
    """Orders written in key order to a new generation's folder and read back."""
    from keystrata.sources.store import scratch
    from keystrata.sources.store import write_sorted

    path = scratch(spark, "s7")
    write_sorted(rows(spark, d, "Order"), entity("Order"), path, 4)
    return spark.read.parquet(path).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


# --- reads ------------------------------------------------------------------------------------------------------------


@query("SELECT * FROM customer WHERE c_custkey = 7")
def r1_get(spark, d):
    return reads.get(rows(spark, d, "Customer"), entity("Customer"), {"c_custkey": 7}).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("SELECT c_custkey, pos FROM (VALUES (3, 0), (999999999, 1), (1, 2), (4, 4)) k(c_custkey, pos) JOIN customer USING (c_custkey)")
def r3_batch_get(spark, d):
    asked = spark.createDataFrame([(3, 0), (999999999, 1), (1, 2), (3, 3), (4, 4)], "c_custkey long, pos int")
    return reads.batch_get(rows(spark, d, "Customer"), entity("Customer"), asked).select("c_custkey", "pos")


@query("SELECT c_custkey FROM customer WHERE c_name = (SELECT c_name FROM customer WHERE c_custkey = 5)")
def r4_unique_lookup(spark, d):
    e, all_ = entity("Customer"), rows(spark, d, "Customer")
    name = (reads.get(all_, e, {"c_custkey": 5}).first() or {"c_name": ""})["c_name"]
    return reads.unique_lookup(all_, derive.claims(all_, e, "Name"), e, "Name", {"c_name": name}).select("c_custkey")


@query("SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w = 'the'")
def r5_unique_element(spark, d):
    e, docs = tagged(spark, d)
    return reads.unique_lookup(docs, derive.claims(docs, e, "Word"), e, "Word", {"tags": "the"}).select("doc_id")


FROM, TO = datetime(1995, 1, 1), datetime(1997, 12, 31)


def _page(spark, d, access, partition, **kw):
    e = entity("Order")
    return reads.query(rows(spark, d, "Order"), e, e.reads(access), partition, **kw).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate, o_orderkey LIMIT 20")
def r6_query(spark, d):
    return _page(spark, d, "History", {"o_custkey": 7})


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1997-12-31' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def r9_range(spark, d):
    return _page(spark, d, "History", {"o_custkey": 7}, low=FROM, high=TO)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 AND o_orderdate >= TIMESTAMP '1995-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def r10_from(spark, d):
    return _page(spark, d, "History", {"o_custkey": 7}, low=FROM)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 AND o_orderdate <= TIMESTAMP '1997-12-31' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def r11_to(spark, d):
    return _page(spark, d, "History", {"o_custkey": 7}, high=TO)


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) >= 'b' AND (lower(p_name) <= 'm' OR starts_with(lower(p_name), 'm'))")
def r9_text_range(spark, d):
    """Text bounds: the upper one also admits what goes on after it."""
    e = entity("Part")
    return rows(spark, d, "Part").filter(K.bounds(e, e.index("ByBrand").sk, "p_name", "b", "m")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 3")
def r13_desc(spark, d):
    return _page(spark, d, "Latest", {"o_custkey": 7}, size=3)


@query("SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_custkey = 7) WHERE r > 3 AND r <= 6")
def r16_next_page(spark, d):
    """The page after the first three rows, by the key that its cursor holds."""
    e = entity("Order")
    a = e.reads("History")
    scope = reads.scope("shop", a, {"o_custkey": 7})
    first = _page(spark, d, "History", {"o_custkey": 7}, size=3).collect()
    if not first:
        return _page(spark, d, "History", {"o_custkey": 7}, size=3)
    cursor = reads.encode_cursor(scope, {"o_orderdate": first[-1]["o_orderdate"].isoformat(), "o_orderkey": first[-1]["o_orderkey"]}, b"key")
    last = reads.decode_cursor(cursor, scope, (b"newer", b"key"))
    last["o_orderdate"] = datetime.fromisoformat(last["o_orderdate"])
    return _page(spark, d, "History", {"o_custkey": 7}, size=3, after=last)


@query(f"SELECT * EXCLUDE r FROM (SELECT event_id, floor(epoch(ts))::BIGINT + 604800 AS expires, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id = 7) WHERE r <= 10 AND expires > {NOW}")
def r15_page_before_filter(spark, d):
    e = entity("Event")
    return reads.query(rows(spark, d, "Event"), e, e.reads("Recent"), {"user_id": 7}, now=NOW).select("event_id", "expires")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE {URGENCY} = '1-URGENT' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def r7_gsi_sparse(spark, d):
    e = entity("Order")
    return reads.query(rows(spark, d, "Order"), e, e.reads("Urgent"), {"o_urgency": "1-URGENT"}).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def r8_copy(spark, d):
    e = entity("Order")
    return reads.query(rows(spark, d, "Order"), e, e.reads("OpenOrders"), {"o_custkey": 7}).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r <= 2")
def l3_first_page_per_key(spark, d):
    return reads.first_pages(rows(spark, d, "Order"), entity("Order"), 2).select("o_custkey", "o_orderkey", "rank")


@query(f"SELECT {KEY.format('c_custkey')} AS PK, 'CUSTOMER' AS SK, 'Customer' AS _t, c_name, NULL::BIGINT AS o_orderkey FROM customer WHERE c_custkey = 7 UNION ALL SELECT {KEY.format('o_custkey')}, {ORDER_SK}, 'Order', NULL, o_orderkey FROM orders WHERE o_custkey = 7")
def r18_partition_read(spark, d):
    c, o = entity("Customer"), entity("Order")
    parts = [(c, rows(spark, d, "Customer")), (o, rows(spark, d, "Order"))]
    return reads.partition_read(parts, {"c_custkey": 7, "o_custkey": 7}).select("PK", "SK", "_t", "c_name", "o_orderkey")


COUNTS = "SELECT o_custkey, count(*) AS orders, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus <> 'O') AS closed FROM orders GROUP BY 1"


@query(f"SELECT k.o_custkey, coalesce(orders, 0) AS orders, coalesce(open, 0) AS open FROM (VALUES (7), (999999999)) k(o_custkey) LEFT JOIN ({COUNTS}) USING (o_custkey)")
def r20_counter(spark, d):
    e = entity("Order")
    c = derive.counters_by_field(rows(spark, d, "Order").filter("o_custkey in (7, 999999999)"), e, e.counter("CustomerOrders"))
    return reads.counter_read(c, {"o_custkey": 7}, ["orders", "open"], spark).unionByName(reads.counter_read(c, {"o_custkey": 999999999}, ["orders", "open"], spark))


@query("SELECT o_orderstatus, count(*) AS orders FROM orders GROUP BY 1")
def r21_sharded(spark, d):
    e = entity("Order")
    return derive.sharded_totals(rows(spark, d, "Order"), e, e.counter("StatusTotals")).select("o_orderstatus", "orders")


@query("SELECT user_id, event_type, count(*) AS events FROM events WHERE user_id = 7 GROUP BY ALL")
def r22_counter_all(spark, d):
    e = entity("Event")
    return derive.counters_by_field(rows(spark, d, "Event").filter("user_id = 7"), e, e.counter("Types"))


@query("SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def r23_set_index(spark, d):
    """Entries of an index keyed by the elements of a set: one for each distinct element, none for an empty one."""
    e, docs = tagged(spark, d)
    return reads.index_view(docs, e, "ByWord").groupBy(F.col("_element").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lower(p_name) AS k, count(*) AS n FROM part GROUP BY 1")
def r24_lower(spark, d):
    name = K.fmt(F.col("p_name"), entity("Part").field("p_name"), lower=True)
    return rows(spark, d, "Part").groupBy(name.alias("k")).agg(F.count(F.lit(1)).alias("n"))


# --- derived data -----------------------------------------------------------------------------------------------------


@query(COUNTS)
def a2_conditional(spark, d):
    e = entity("Order")
    return derive.counters_by_field(rows(spark, d, "Order"), e, e.counter("CustomerOrders"))


@query("SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units, count(*) AS n FROM lineitem GROUP BY 1")
def a3_sum(spark, d):
    units = Counter("Units", parse_template("S#{l_suppkey}"), parse_template("UNITS"), (Value("units", sum="l_quantity"), Value("n")))
    return derive.counters_by_field(rows(spark, d, "Line"), entity("Line"), units)


@query("SELECT source, word, count(*) AS docs FROM (SELECT DISTINCT doc_id, source, unnest(string_split(text, ' ')) AS word FROM documents) WHERE word <> '' GROUP BY ALL")
def a5_set_counter(spark, d):
    e, docs = tagged(spark, d)
    return derive.counters_by_field(docs, e, e.counter("Words")).withColumnRenamed("tags", "word")


@query(f"SELECT {URGENCY} AS o_urgency, count(*) AS n FROM orders WHERE {URGENCY} IS NOT NULL GROUP BY 1")
def a6_sparse_counter(spark, d):
    c = Counter("Urgencies", parse_template("URG#{o_urgency}"), parse_template("N"), (Value("n"),))
    return derive.counters_by_field(rows(spark, d, "Order"), entity("Order"), c)


def _closed(o: DataFrame) -> DataFrame:
    """Orders after a day's changes: every open one of an even key closes, keys divisible by 11 go, others move on."""
    after = o.filter("o_orderkey % 11 <> 0")
    return after.withColumn("o_orderstatus", F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0), "F").otherwise(F.col("o_orderstatus")))


AFTER = "(SELECT * REPLACE (CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderkey % 11 <> 0)"


@query(f"""WITH c AS (SELECT o_custkey, -1 AS s, o_orderstatus AS st FROM orders UNION ALL SELECT o_custkey, 1, o_orderstatus FROM {AFTER}),
t AS (SELECT {KEY.format('o_custkey')} AS PK, 'COUNTS' AS SK, CAST(sum(s) AS BIGINT) AS orders, CAST(sum(CASE WHEN st = 'O' THEN s ELSE 0 END) AS BIGINT) AS open, CAST(sum(CASE WHEN st <> 'O' THEN s ELSE 0 END) AS BIGINT) AS closed FROM c GROUP BY o_custkey) SELECT * FROM t WHERE orders <> 0 OR open <> 0 OR closed <> 0""")
def a9_counter_delta(spark, d):
    e, o = entity("Order"), rows(spark, d, "Order")
    return derive.counter_delta(o, _closed(o), e, e.counter("CustomerOrders"))


@query(f"WITH a AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS open FROM {AFTER} GROUP BY 1) SELECT {KEY.format('o.o_custkey')} AS PK, 'COUNTS' AS SK, coalesce(a.open, 0) AS open FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN a USING (o_custkey)")
def a8_zero_counters(spark, d):
    e, o = entity("Order"), rows(spark, d, "Order")
    c = e.counter("CustomerOrders")
    return derive.kept_counters(derive.counter_items(o, e, c), derive.counter_items(_closed(o), e, c), ["open"])


@query("SELECT 'UNIQUE#Part.PartName#' || p_name AS PK, 'UNIQUE' AS SK, count(*) AS owners FROM part GROUP BY p_name HAVING count(*) > 1")
def d2_claim_conflicts(spark, d):
    return derive.claim_conflicts(rows(spark, d, "Part"), entity("Part"), "PartName")


@query("""WITH b AS (SELECT c_custkey, c_name FROM customer), a AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_name || 'x' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 7 <> 0)
SELECT 'UNIQUE#Customer.Name#' || coalesce(a.c_name, b.c_name) AS PK, 'UNIQUE' AS SK, CASE WHEN a.c_name IS NULL THEN 'delete' ELSE 'put' END AS op FROM b FULL JOIN a ON a.c_name = b.c_name WHERE a.c_name IS NULL OR b.c_name IS NULL OR a.c_custkey <> b.c_custkey""")
def d3_claim_changes(spark, d):
    c = rows(spark, d, "Customer")
    after = c.filter("c_custkey % 7 <> 0").withColumn("c_name", F.expr("case when c_custkey % 5 = 0 then c_name || 'x' else c_name end"))
    return derive.claim_changes(c, after, entity("Customer"), "Name")


@query(f"""WITH b AS (SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderstatus = 'O'), a AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM {AFTER} WHERE o_orderstatus = 'O')
SELECT {KEY.format('coalesce(a.o_custkey, b.o_custkey)')} || '#OPEN' AS PK, 'AT#' || {TIME.format('coalesce(a.o_orderdate, b.o_orderdate)')} || '#' || printf('%019d', coalesce(a.o_orderkey, b.o_orderkey)) AS SK, CASE WHEN a.o_orderkey IS NULL THEN 'delete' ELSE 'put' END AS op FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey AND a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice""")
def d5_copy_changes(spark, d):
    e, o = entity("Order"), rows(spark, d, "Order")
    after = _closed(o).withColumn("o_totalprice", F.expr("case when o_orderkey % 3 = 0 then o_totalprice + 1 else o_totalprice end"))
    return derive.copy_changes(o, after, e, "Open")


@query(f"""SELECT 'counter' AS kind, 'CustomerOrders' AS name, count(DISTINCT o_custkey) AS n FROM orders UNION ALL SELECT 'copy', 'Open', count(*) FILTER (o_orderstatus = 'O') FROM orders
UNION ALL SELECT 'counter', 'StatusTotals', count(DISTINCT (o_orderstatus, {FNV.format(KEY.format('o_custkey') + " || '~' || " + ORDER_SK).replace("ascii(x)::BIGINT", "CASE WHEN x = '~' THEN 0 ELSE ascii(x) END::BIGINT")} % 8)) FROM orders""")
def d1_all_derived(spark, d):
    """Items of all derived data; a sharded counter has one for each shard that some owner falls into."""
    e = entity("Order")
    return derive.all_derived(rows(spark, d, "Order"), e).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


# --- join-shaped operators --------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity <= 10 AS ask, o_orderstatus = 'O' AS met FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def j2_requires(spark, d):
    """Lines need their order to be open."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") <= 10).alias("ask"))
    orders = rows(spark, d, "Order").select("o_orderkey", "o_orderstatus")
    r = Require("Order", (("o_orderkey", "l_orderkey"),), (Pred("o_orderstatus", ("O",)),))
    return writes.requirement(lines, orders, entity("Order"), r).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ask", "met")


@query("SELECT doc_id, q.quality IS NULL OR q.quality = 1 AS met FROM documents LEFT JOIN labels q USING (doc_id)")
def j3_optional(spark, d):
    label = Entity("Label", (Field("doc_id", "int"), Field("quality", "int")), parse_template("D#{doc_id}"), parse_template("LABEL"))
    r = Require("Label", (("doc_id", "doc_id"),), (Pred("quality", (1,)),), optional=True)
    docs = table(spark, d, "documents").select("doc_id")
    return writes.requirement(docs, table(spark, d, "labels").select("doc_id", "quality"), label, r).select("doc_id", "met")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j4_absence(spark, d):
    urgent = rows(spark, d, "Order").filter(holds(entity("Order"), (Pred("o_urgency", ("1-URGENT",)),)))
    return writes.absence(table(spark, d, "customer").select("c_custkey"), urgent, {"o_custkey": "c_custkey"}).filter("met").select("c_custkey")


@query("SELECT c_custkey, count(o_orderkey) FILTER (o_orderstatus = 'O') = 0 AS met FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j5_counter_req(spark, d):
    e = entity("Order")
    c = derive.counters_by_field(rows(spark, d, "Order"), e, e.counter("CustomerOrders")).withColumnRenamed("o_custkey", "c_custkey")
    return writes.counter_requirement(table(spark, d, "customer").select("c_custkey"), c, ["c_custkey"], {"open": 0}).select("c_custkey", "met")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s_nationkey IS NOT DISTINCT FROM CAST(l_linenumber AS INT) AS met FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def j6_field_to_field(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    r = Require("Supplier", (("s_suppkey", "l_suppkey"),), (Pred("s_nationkey", source="l_linenumber"),))
    return writes.requirement(lines, rows(spark, d, "Supplier"), entity("Supplier"), r).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "met")


@query("SELECT count(*) AS sources, avg(n) AS typical, max(n) AS most FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def j11_fanout(spark, d):
    return analysis.copy_fan_out(table(spark, d, "orders"), ["o_custkey"])


# --- writes -----------------------------------------------------------------------------------------------------------


def _new_orders(spark, d):
    """All orders as commands to place them: most keys are taken, some are new, and some of those come twice."""
    o = rows(spark, d, "Order")
    moved = o.withColumn("seq", F.col("o_orderkey")).withColumn("o_custkey", F.expr("case when o_orderkey % 10 = 1 then o_custkey + 1000000 else o_custkey end"))
    return moved.unionByName(moved.filter("o_orderkey % 20 = 1").withColumn("seq", F.col("seq") + 10_000_000))


@query("""WITH m AS (SELECT *, o_orderkey AS seq, CASE WHEN o_orderkey % 10 = 1 THEN o_custkey + 1000000 ELSE o_custkey END AS ck FROM orders), c AS (SELECT * FROM m UNION ALL SELECT * REPLACE (seq + 10000000 AS seq) FROM m WHERE o_orderkey % 20 = 1)
SELECT c.o_orderkey, seq, CASE WHEN o.o_orderkey IS NOT NULL OR seq >= 10000000 THEN 'exists' ELSE 'ok' END AS outcome, 'O' AS o_orderstatus FROM c LEFT JOIN orders o ON o.o_orderkey = c.o_orderkey AND o.o_custkey = c.ck AND o.o_orderdate = c.o_orderdate""")
def w1_create(spark, d):
    e = entity("Order")
    done = writes.create(_new_orders(spark, d), rows(spark, d, "Order"), e, e.write("Place"))
    return done.select("o_orderkey", "seq", "outcome", "o_orderstatus")


def _commands(spark, d, **columns):
    """A command for every order, and some for orders that don't exist."""
    o = rows(spark, d, "Order").select("o_custkey", "o_orderdate", "o_orderkey")
    missing = o.filter("o_orderkey % 50 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 50_000_000)
    return o.unionByName(missing).withColumns({k: F.expr(v) for k, v in columns.items()})


@query("""WITH c AS (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey + 50000000 FROM orders WHERE o_orderkey % 50 = 0)
SELECT c.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'not_found' WHEN o_orderstatus <> 'O' THEN 'precondition' ELSE 'ok' END AS outcome, CASE WHEN o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS new_o_orderstatus FROM c LEFT JOIN orders o USING (o_orderkey)""")
def w3_update(spark, d):
    """Open orders close, by key."""
    e = entity("Order")
    done = writes.update(_commands(spark, d), rows(spark, d, "Order"), e, e.write("Close"))
    return done.select("o_orderkey", "outcome", "new_o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def w7_set(spark, d):
    """The snapshot after the accepted ones of commands for all orders; some expect another revision."""
    e, o = entity("Order"), rows(spark, d, "Order").withColumn("_rev", F.lit(3).cast("bigint"))
    done = writes.update(_commands(spark, d, expect_rev="case when o_orderkey % 5 = 0 then 2L else 3L end"), o, e, e.write("Close"))
    return writes.apply_update(o, done, e, e.write("Close")).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'unchanged' WHEN o_orderkey % 3 = 1 THEN 'ok' WHEN o_orderpriority = 'x' THEN 'unchanged' ELSE 'ok' END AS outcome, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN NULL ELSE 'x' END AS new_o_orderpriority FROM orders")
def w6_patch(spark, d):
    """Three kinds of argument: none leaves the field, nothing clears it, a value replaces it."""
    e = entity("Order")
    args = {"has_o_orderpriority": "o_orderkey % 3 <> 0", "o_orderpriority": "case when o_orderkey % 3 = 2 then 'x' end"}
    c = rows(spark, d, "Order").select(*e.key_fields).withColumns({k: F.expr(v) for k, v in args.items()})
    return writes.update(c, rows(spark, d, "Order"), e, e.write("Note")).select("o_orderkey", "outcome", "new_o_orderpriority")


@query("""WITH t AS (SELECT doc_id, list_sort(list_distinct(string_split(text, ' '))) AS tags FROM documents), n AS (SELECT doc_id, tags, list_sort(list_distinct(list_concat(list_filter(tags, lambda x: x <> 'the'), ['new']))) AS now FROM t)
SELECT doc_id, array_to_string(now, '|') AS tags, CASE WHEN now = tags THEN 'unchanged' ELSE 'ok' END AS outcome FROM n""")
def w8_set_add_remove(spark, d):
    e, docs = tagged(spark, d)
    w = Write("Tag", "update", add_to=(("tags", "new"),), remove_from=(("tags", "the"),))
    done = writes.update(docs.select("doc_id"), docs, e, w)
    return done.select("doc_id", F.array_join(F.array_sort("new_tags"), "|").alias("tags"), "outcome")


@query("SELECT doc_id, CASE WHEN list_contains(string_split(text, ' '), 'the') THEN 'unchanged' ELSE 'ok' END AS outcome FROM documents")
def w9_unchanged(spark, d):
    e, docs = tagged(spark, d)
    return writes.update(docs.select("doc_id"), docs, e, Write("Tag", "update", add_to=(("tags", "the"),))).select("doc_id", "outcome")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0")
def w10_delete(spark, d):
    """What is left after commands to delete every order; some expect another revision."""
    e, o = entity("Order"), rows(spark, d, "Order").withColumn("_rev", F.lit(3).cast("bigint"))
    done = writes.delete(_commands(spark, d, expect_rev="case when o_orderkey % 5 = 0 then 3L else 2L end"), o, e, e.write("Cancel"))
    return writes.after_delete(o, done, e).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'version_mismatch' WHEN o_orderstatus = 'F' THEN 'precondition' ELSE 'ok' END AS outcome FROM orders UNION ALL SELECT o_orderkey + 50000000, 'not_found' FROM orders WHERE o_orderkey % 50 = 0")
def w11_w14_guard(spark, d):
    """Not found, then the version, then the condition."""
    e = entity("Order")
    snap = rows(spark, d, "Order").withColumn("_rev", F.lit(3).cast("bigint"))
    c = _commands(spark, d, expect_rev="case when o_orderkey % 3 = 1 then 2L when o_orderkey % 3 = 2 then 3L end", o_totalprice="1.0D")
    return writes.guarded(c, snap, e, e.write("Reprice")).select("o_orderkey", "outcome")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE lower(to_base(o_orderkey, 36)) END AS version FROM orders")
def w14_version_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", K.version_text(F.expr("case when o_orderkey % 7 = 0 then 0L else o_orderkey end")).alias("version"))


FOLD = """WITH RECURSIVE q AS (SELECT {k} AS k, {d} AS d, row_number() OVER (PARTITION BY {k} ORDER BY {o}) AS r FROM {t}),
f AS (SELECT k, 0::BIGINT AS r, 0::BIGINT AS v, false AS ok FROM (SELECT DISTINCT k FROM q) UNION ALL SELECT q.k, q.r, CASE WHEN {c} THEN f.v + q.d ELSE f.v END, {c} FROM f JOIN q ON q.k = f.k AND q.r = f.r + 1)
SELECT k, r AS seq, ok AS admitted, v AS value FROM f WHERE r > 0"""


def _ordered_lines(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("bigint").alias("d"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    w = Window.partitionBy("k").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "d")
    return line.select("k", "d", F.row_number().over(w).cast("bigint").alias("seq"))


@query(FOLD.format(k="l_suppkey", d="CAST(l_quantity AS BIGINT)", o="l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity", t="lineitem", c="f.v + q.d <= 500"))
def w15_limit(spark, d):
    return writes.admit(_ordered_lines(spark, d), ["k"], ["seq"], "d", most=500).select("k", "seq", "admitted", "value")


@query(FOLD.format(k="l_suppkey", d="CASE WHEN l_orderkey % 2 = 0 THEN CAST(l_quantity AS BIGINT) ELSE -CAST(l_quantity AS BIGINT) END", o="l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity", t="lineitem", c="(q.d >= 0 OR f.v + q.d >= 0)"))
def w16_min(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("bigint").alias("d"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    w = Window.partitionBy("k").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "d")
    signed = line.select("k", F.expr("case when l_orderkey % 2 = 0 then d else -d end").alias("d"), F.row_number().over(w).cast("bigint").alias("seq"))
    return writes.admit(signed, ["k"], ["seq"], "d", least=0).select("k", "seq", "admitted", "value")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= 5 AS admitted FROM orders")
def w15_equal_limit(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return writes.admit_equal(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 1, 5).select("o_custkey", "o_orderkey", "admitted")


@query("SELECT s_suppkey, s_nationkey, s_nationkey + coalesce(n, 0) AS after_add FROM supplier LEFT JOIN (SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem WHERE l_quantity < 5 GROUP BY 1) ON l_suppkey = s_suppkey")
def w17_add(spark, d):
    s = rows(spark, d, "Supplier")
    small = table(spark, d, "lineitem").filter("l_quantity < 5").withColumn("seq", F.col("l_orderkey"))
    r = Require("Supplier", (("s_suppkey", "l_suppkey"),), add=(("s_nationkey", "l_linenumber"),))
    done = writes.changes_on_target(small, s, entity("Supplier"), r).select("s_suppkey", F.col("s_nationkey").alias("after_add"))
    return s.select("s_suppkey", "s_nationkey").join(done, "s_suppkey")


@query("SELECT c_custkey, coalesce(p, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) FILTER (o_orderpriority <> '5-LOW') AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def w17_patch_target(spark, d):
    """A target's field takes the last value that isn't empty."""
    o = rows(spark, d, "Order").withColumn("seq", F.col("o_orderkey")).withColumn("o_urgency", F.coalesce("o_urgency", F.lit("")))
    r = Require("Customer", (("c_custkey", "o_custkey"),), patch=(("c_mktsegment", "o_urgency"),))
    return writes.changes_on_target(o, rows(spark, d, "Customer"), entity("Customer"), r).select("c_custkey", "c_mktsegment")


@query("SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(c_nationkey, 0) + coalesce(n, 0) AS c_nationkey FROM customer FULL JOIN (SELECT o_custkey + 700 AS k, count(*) AS n FROM orders GROUP BY 1) ON k = c_custkey")
def w19_ensure(spark, d):
    o = rows(spark, d, "Order").select((F.col("o_custkey") + 700).alias("k"), F.col("o_orderkey").alias("seq"))
    r = Require("Customer", (("c_custkey", "k"),), add=(("c_nationkey", 1),), ensure=True)
    return writes.changes_on_target(o, rows(spark, d, "Customer"), entity("Customer"), r).select("c_custkey", "c_nationkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def w18_consume(spark, d):
    """Every order consumes its customer."""
    return writes.consume(rows(spark, d, "Order"), rows(spark, d, "Customer"), Require("Customer", (("c_custkey", "o_custkey"),))).select("c_custkey")


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'O') > 0")
def w20_counter_zero(spark, d):
    """Counters that stay: those with any value above zero can't be consumed."""
    e = entity("Order")
    c = derive.counters_by_field(rows(spark, d, "Order"), e, e.counter("CustomerOrders"))
    ok = writes.counter_requirement(c.select("o_custkey"), c, ["o_custkey"], {"open": 0}).filter("met")
    return c.join(ok, "o_custkey", "left_anti").select("o_custkey")


@query(f"SELECT o_orderkey, {URGENCY} IS NULL AS empty_key, {URGENCY} IS NULL OR r IS NOT NULL AS met FROM orders LEFT JOIN (SELECT DISTINCT o_orderpriority AS r FROM orders WHERE o_orderpriority < '3') ON r = {URGENCY}")
def w21_empty_key(spark, d):
    e = Entity("Urgency", (Field("r"),), parse_template("U#{r}"), parse_template("URGENCY"))
    o = rows(spark, d, "Order")
    known = o.filter("o_orderpriority < '3'").select(F.col("o_orderpriority").alias("r")).distinct()
    done = writes.requirement(o, known, e, Require("Urgency", (("r", "o_urgency"),), optional=True))
    met = F.when(F.col("o_urgency").isNull(), F.col("met")).otherwise(F.col("target_r").isNotNull())
    return done.select("o_orderkey", F.col("o_urgency").isNull().alias("empty_key"), met.alias("met"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) <= 100 AS ok FROM orders")
def w22_transaction_size(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", writes.transaction_size_ok(n).alias("ok"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS tried, CASE WHEN bool_or(l_quantity < 10) THEN 0 ELSE 1 END::BIGINT AS done, CASE WHEN bool_or(l_quantity < 10) OR count(*) > 1 THEN 'exists' END AS failure FROM lineitem GROUP BY 1, 2""")
def w25_batch_outcome(spark, d):
    """Lines as one batch of creates under a shorter key. Of commands for one item the first applies, unless the item is there
    already; the others fail alone, not the batch."""
    _, new = _rekeyed()
    lines = rows(spark, d, "Line")
    place = F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    done = writes.create(lines.withColumn("seq", place), lines.filter("l_quantity < 10"), new, Write("Add", "create"))
    return writes.batched(done, new.key_fields, ["seq"])


@query(f"SELECT {KEY.format('o_custkey')} AS PK, 'COUNTS' AS SK, count(*) AS orders, count(*) AS open, CAST(0 AS BIGINT) AS closed FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def w25_merged_counters(spark, d):
    """All orders as one batch of commands to place them, where those that are filled are there already: what the others add to
    their customers' counters, once for each."""
    e, o = entity("Order"), rows(spark, d, "Order")
    _, _, merged = writes.batch_create(o.withColumn("seq", F.col("o_orderkey")), o.filter("o_orderstatus = 'F'"), e, e.write("Place"))
    return merged["CustomerOrders"]


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def w27_duplicates(spark, d):
    """Items that several commands of one batch touch."""
    keys = ["l_orderkey", "l_linenumber"]
    again = writes.duplicates(table(spark, d, "lineitem"), keys, "l_extendedprice").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("first")).alias("refused"))
    return again.filter("refused > 0").select(*keys, "n")


@query("""SELECT 'Orders' AS entity, o_custkey, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'Counts', o_custkey, count(*) FROM orders GROUP BY 2""")
def w22_atomic_commit(spark, d):
    """Orders and their counters, each in a snapshot of its own, moved on by transactions that commit both or neither: first the
    orders that are closed, then the others. A transaction that read an older state is refused."""
    from keystrata.sources.store import CommitConflict, Store, scratch, transact

    store = Store(spark, scratch(spark, "w22"))
    o = rows(spark, d, "Order").select("o_custkey", "o_orderkey", "o_orderstatus")
    store.commit_all({"Orders": o.limit(0), "Counts": o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).limit(0)}, {"Orders": None, "Counts": None})
    early = store.versions("Orders", "Counts")

    def place(which: str):
        def work(now):
            fresh = o.filter(which)
            moved = now["Counts"].unionByName(fresh.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")))
            return {"Orders": now["Orders"].unionByName(fresh), "Counts": moved.groupBy("o_custkey").agg(F.sum("n").alias("n"))}

        return work

    for which in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        transact(store, ["Orders", "Counts"], place(which), writes.waits([1.0] * writes.RETRIES))
    try:
        store.commit_all({"Orders": o.limit(0), "Counts": store.read("Counts").limit(0)}, early)
    except CommitConflict:
        pass
    n = store.read("Orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.lit("Orders").alias("entity"), "o_custkey", "n").unionByName(store.read("Counts").select(F.lit("Counts").alias("entity"), "o_custkey", "n"))


# --- cost and analysis ------------------------------------------------------------------------------------------------

SIZE = "CAST(4 + 23 + strlen('TURN#') + 19 + (2 + 4 + 2 + 2) + 7 + 76 + 7 + strlen(conv_id::VARCHAR) + 4 + strlen(turn::VARCHAR) + 4 + strlen(role) + 4 + strlen(text) AS BIGINT)"
SIZE = SIZE.replace("4 + 23 + strlen('TURN#')", "4 + strlen('CONV#') + 19 + strlen('TURN#')")


@query(f"SELECT conv_id, turn, {SIZE} AS bytes FROM conversations")
def z3_item_size(spark, d):
    return rows(spark, d, "Turn").select("conv_id", "turn", cost.observed_item_size(entity("Turn")).alias("bytes"))


@query(f"SELECT conv_id, turn, CAST(greatest(1, ceil({SIZE} / 1024.0)) AS BIGINT) AS wru, CAST(greatest(1, ceil({SIZE} / 4096.0)) * 0.5 AS DOUBLE) AS rru FROM conversations")
def z5_z6_units(spark, d):
    b = cost.observed_item_size(entity("Turn"))
    return rows(spark, d, "Turn").select("conv_id", "turn", cost.observed_write_units(b).alias("wru"), cost.observed_read_units(b).cast("double").alias("rru"))


@query(f"SELECT count(*) AS n_items, quantile_cont({SIZE}, 0.5) AS p50, quantile_cont({SIZE}, 0.99) AS p99, CAST(sum({SIZE}) AS BIGINT) AS bytes FROM conversations")
def z1_size_summary(spark, d):
    return cost.size_summary(rows(spark, d, "Turn"), entity("Turn")).select("n_items", "p50", "p99", "bytes")


@query(f"SELECT CAST(sum({SIZE} + 100) AS BIGINT) AS stored, round(sum({SIZE} + 100) / 1073741824.0 * 0.25, 9) AS usd, round(sum(greatest(1, ceil({SIZE} / 1024.0))) * 2592000 / 1e6 * 0.625, 4) AS monthly FROM conversations")
def z12_z13_money(spark, d):
    b = F.col("b")
    sized = rows(spark, d, "Turn").select(cost.observed_item_size(entity("Turn")).alias("b"))
    stored = F.sum(b + cost.OVERHEAD).cast("bigint")
    return sized.agg(stored.alias("stored"), F.round(stored / 1073741824.0 * cost.PRICE_GB, 9).alias("usd"), F.round(F.sum(cost.observed_write_units(b)) * cost.SECONDS_PER_MONTH / 1e6 * cost.PRICE_WRITE, 4).alias("monthly"))


@query(f"SELECT CAST(ceil(sum({SIZE}) / 4096.0) * 0.5 AS DOUBLE) AS rru FROM conversations")
def z14_scan_cost(spark, d):
    sized = rows(spark, d, "Turn").select(cost.observed_item_size(entity("Turn")).alias("b"))
    return sized.agg(cost.scan_units(F.sum("b")).cast("double").alias("rru"))


@query("SELECT o_custkey, count(*) AS n, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM orders GROUP BY 1")
def z17_z26_items_and_pages(spark, d):
    return analysis.items_per_key(table(spark, d, "orders"), ["o_custkey"]).withColumn("pages", cost.pages_to_read(F.col("n"), 20))


@query("SELECT 'Order' AS family, count(*) AS partitions, CAST(sum(n) AS BIGINT) AS items, avg(n) AS typical, max(n) AS largest, max(n) / sum(n) AS busiest_share FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def z20_z22_partitions(spark, d):
    return analysis.partition_summary(table(spark, d, "orders"), ["o_custkey"], "Order")


@query("""WITH p AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT *, n / sum(n) OVER () * 400 * 5 AS w, n / sum(n) OVER () * 900 * 5 * 0.5 AS r FROM p)
SELECT o_orderpriority, n, round(w, 6) AS wru_s, round(r, 6) AS rru_s, CASE WHEN greatest(w / 1000, r / 3000) >= 0.5 THEN 'high' WHEN greatest(w / 1000, r / 3000) >= 0.1 THEN 'medium' ELSE 'low' END AS risk FROM t""")
def z23_z24_traffic(spark, d):
    per = analysis.items_per_key(table(spark, d, "orders"), ["o_orderpriority"])
    t = analysis.traffic(per, ["o_orderpriority"], 400, 900, design().peak, F.lit(1.0), F.lit(0.5))
    return t.select("o_orderpriority", "n", F.round("wru_s", 6).alias("wru_s"), F.round("rru_s", 6).alias("rru_s"), "risk")


@query("SELECT f AS from_state, event_type AS to_state, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) GROUP BY ALL")
def z27_lifecycle(spark, d):
    return analysis.lifecycle(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("SELECT e AS final_state, count(*) AS n FROM (SELECT user_id, max_by(event_type, (ts, event_id)) AS e FROM events GROUP BY 1) GROUP BY 1")
def z27_final_states(spark, d):
    return analysis.final_states(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("SELECT user_id, max(n) AS busiest, CAST(sum(n) AS BIGINT) AS writes FROM (SELECT user_id, date_trunc('hour', ts) AS u, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def z30_counter_load(spark, d):
    return analysis.counter_load(table(spark, d, "events"), ["user_id"], "ts")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def l5_largest(spark, d):
    return analysis.largest_partitions(table(spark, d, "orders"), ["o_custkey"], 10)


@query(_raw() + ", n AS (SELECT entity, CAST(total AS DOUBLE) AS items FROM e WHERE per IS NULL UNION ALL SELECT e.entity, n.items * e.typical FROM e JOIN n ON e.per = n.entity) SELECT entity, items FROM n")
def z15_counts(spark, d):
    return spark.createDataFrame(list(cost.counts(design()).items()), "entity string, items double")


@query()
def z8_write_touches(spark, d):
    out = [(e.name, w.name, t.kind, t.name, float(t.count), t.size[0], cost.write_units(t.size[0])) for e in design().entities for w in e.writes for t in cost.touches(design(), e, w)]
    return spark.createDataFrame(out, "entity string, write string, kind string, name string, n double, bytes int, wru int")


@query()
def z29_alternative(spark, d):
    e = entity("Order")
    return analysis.alternatives(spark, design(), e, e.index("Open"))


@query(_raw() + """ SELECT 'table' AS space, pk, entity AS family FROM e UNION ALL SELECT space, pk, entity || '.' || name FROM t
UNION ALL SELECT 'table', 'UNIQUE#' || entity || '.' || name || '#' || string_agg('{' || field || '}', '#'), entity || '.' || name FROM u GROUP BY entity, name""")
def z19_families(spark, d):
    return spark.createDataFrame(analysis.families(design()), "space string, pk string, family string")


@query()
def f_declared_findings(spark, d):
    return spark.createDataFrame([(f.rule, f.severity, f.subject, f.text) for f in analysis.findings(design())], "rule string, severity string, subject string, text string")


@query(f"SELECT 'Turn' AS subject, quantile_cont({SIZE}, 0.99) AS p99, CASE WHEN quantile_cont({SIZE}, 0.99) > 409600 THEN 'error' WHEN quantile_cont({SIZE}, 0.99) > 102400 THEN 'warning' ELSE 'none' END AS severity FROM conversations")
def f_item_size(spark, d):
    return analysis.finding_item_size(rows(spark, d, "Turn"), entity("Turn"))


@query("SELECT 'text' AS subject, quantile_cont(strlen(text), 0.99) AS p99, quantile_cont(strlen(text), 0.99) >= 8192 AS large FROM documents")
def f_large_field(spark, d):
    return analysis.finding_large_field(table(spark, d, "documents"), "text")


@query(f"SELECT 'ByUrgency' AS subject, count(*) AS n_rows, count({URGENCY}) AS n_entries, count({URGENCY}) / count(*) AS share FROM orders")
def f_sparse_index(spark, d):
    return analysis.finding_sparse_index(rows(spark, d, "Order"), entity("Order"), "ByUrgency")


@query("SELECT 'o_orderstatus' AS subject, count(*) AS n_keys, max(n) AS largest FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)")
def f_low_cardinality(spark, d):
    return analysis.finding_low_cardinality(table(spark, d, "orders"), ["o_orderstatus"])


@query("SELECT 'p_name' AS subject, count(*) AS repeated_values, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_concerned FROM (SELECT count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1)")
def f_unenforced_unique(spark, d):
    return analysis.finding_unenforced_unique(table(spark, d, "part"), "p_name")


@query("SELECT count(*) AS holders, count(*) FILTER (l_linestatus <> o_orderstatus) AS drifted FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def f_copy_drift(spark, d):
    return analysis.finding_copy_drift(table(spark, d, "lineitem"), table(spark, d, "orders"), [("l_orderkey", "o_orderkey")], "l_linestatus", "o_orderstatus")


@query("SELECT count(*) FILTER (n > 3 * a) AS hot, count(*) AS keys FROM (SELECT count(*) AS n, avg(count(*)) OVER () AS a FROM lineitem GROUP BY l_suppkey)")
def f_hot_partition(spark, d):
    per = analysis.items_per_key(table(spark, d, "lineitem"), ["l_suppkey"])
    mean = per.agg(F.avg("n").alias("a"))
    return per.crossJoin(F.broadcast(mean)).agg(F.count_if(F.col("n") > 3 * F.col("a")).alias("hot"), F.count(F.lit(1)).alias("keys"))  # one row


FOUND = [("item-large", "warning", "Turn"), ("scan", "note", "Order.Export"), ("sparse-index", "warning", "Order.ByUrgency"), ("item-too-large", "error", "Part")]
POLICY = [("scan", "error"), ("volume-missing", "warning")]
ACCEPTED = [("sparse-index", "Order"), ("scan", "Order.Export"), ("item-too-large", "Part"), ("unused-index", "Order.Open")]
VALUES = lambda rows_: ", ".join(str(r) for r in rows_)


@query(f"SELECT f.rule, coalesce(p.severity, f.severity) AS severity, f.subject FROM (VALUES {VALUES(FOUND)}) f(rule, severity, subject) LEFT JOIN (VALUES {VALUES(POLICY)}) p(rule, severity) USING (rule)")
def z31_policy(spark, d):
    return analysis.apply_policy(spark.createDataFrame(FOUND, "rule string, severity string, subject string"), spark.createDataFrame(POLICY, "rule string, severity string"))


@query(f"""WITH f AS (SELECT * FROM (VALUES {VALUES(FOUND)}) t(rule, severity, subject)), a AS (SELECT * FROM (VALUES {VALUES(ACCEPTED)}) t(rule, subject))
SELECT rule, severity, subject, severity <> 'error' AND EXISTS (SELECT 1 FROM a WHERE a.rule = f.rule AND a.subject IN (f.subject, split_part(f.subject, '.', 1))) AS accepted FROM f
UNION ALL SELECT 'accept-invalid', 'error', rule || ':' || subject, false FROM a WHERE NOT EXISTS (SELECT 1 FROM f WHERE a.rule = f.rule AND f.severity <> 'error' AND a.subject IN (f.subject, split_part(f.subject, '.', 1)))""")
def z32_accept(spark, d):
    return analysis.apply_acceptances(spark.createDataFrame(FOUND, "rule string, severity string, subject string"), spark.createDataFrame(ACCEPTED, "rule string, subject string"))


# --- evolution --------------------------------------------------------------------------------------------------------


def _shape_cases() -> list[tuple[str, list, list]]:
    """Shapes before and after, in rows: an order with changes of every kind, and suppliers with one each."""
    e, s = entity("Order"), entity("Supplier")
    order = replace(
        e,
        version=2,
        sk=parse_template("ORDER#{o_orderkey}"),
        fields=tuple(
            replace(f, values=("F", "O")) if f.name == "o_orderstatus" else replace(f, type="string") if f.name == "o_totalprice" else replace(f, required=True) if f.name == "o_orderpriority" else f
            for f in e.fields
            if f.name != "o_urgency"
        )
        + (Field("o_note"), Field("o_code", required=True)),
        indexes=e.indexes[1:],
        uniques=(Unique("Code", ("o_code",), parse_template("UNIQUE#{o_code}"), parse_template("UNIQUE")),),
        counters=(replace(e.counters[0], values=e.counters[0].values[:2]), replace(e.counters[1], shards=4)),
    )
    optional, must = Field("s_note"), Field("s_code", required=True)
    cases = [("order", e, order), ("same", s, s), ("optional", s, replace(s, fields=(*s.fields, optional))), ("required", s, replace(s, fields=(*s.fields, must))), ("gone", s, replace(s, fields=s.fields[:-1]))]
    cases += [("enum", replace(s, fields=(*s.fields, Field("k", "enum", values=("a",)))), replace(s, fields=(*s.fields, Field("k", "enum", values=("a", "b")))))]
    return [(n, evolve.shape_rows(evolve.shape(a)), evolve.shape_rows(evolve.shape(b))) for n, a, b in cases]


def _shape_sql(select: str) -> str:
    """CTE `d`: one row for each part and name of a case that differs, and whether stored items survive it."""
    quoted = lambda x: "'" + str(x).replace("'", "''") + "'"
    values = ", ".join(f"({quoted(n)}, {side}, {', '.join(map(quoted, r))})" for n, *sides in _shape_cases() for side, rows_ in enumerate(sides) for r in rows_)
    return f"""WITH s(c, side, part, name, def) AS (VALUES {values}),
b AS (SELECT c, part, name, max(def) FILTER (side = 0) AS was, max(def) FILTER (side = 1) AS now FROM s GROUP BY c, part, name),
j AS (SELECT *, CASE WHEN part = 'fields' THEN json_extract_string(was, '$.required') = 'true' END AS was_must, CASE WHEN part = 'fields' THEN json_extract_string(now, '$.required') = 'true' END AS must,
  CASE WHEN part = 'fields' THEN json_extract_string(was, '$.type') IS DISTINCT FROM json_extract_string(now, '$.type') END AS retyped,
  CASE WHEN part = 'fields' THEN len(list_filter(CAST(json_extract(was, '$.values') AS VARCHAR[]), lambda x: NOT list_contains(CAST(json_extract(now, '$.values') AS VARCHAR[]), x))) > 0 END AS lost FROM b WHERE was IS DISTINCT FROM now),
d AS (SELECT c, part, name, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN part <> 'fields' THEN false WHEN now IS NULL THEN true WHEN was IS NULL THEN NOT must ELSE NOT retyped AND NOT lost AND (was_must OR NOT must) END AS compatible FROM j)
{select}"""


@query(_shape_sql("SELECT part, name, change, compatible FROM d WHERE c = 'order'"))
def g3_schema_changes(spark, d):
    frame = lambda x: spark.createDataFrame(x, "part string, name string, definition string")
    old, new = next(x[1:] for x in _shape_cases() if x[0] == "order")
    return evolve.classify(frame(old), frame(new))


@query()
def g2_fingerprints(spark, d):
    return spark.createDataFrame([(e.name, evolve.fingerprint(evolve.shape(e))) for e in design().entities], "entity string, fingerprint string")


HISTORY = [("Order", 1, 1, "x", "int"), ("Order", 1, 2, "x", "string"), ("Order", 2, 3, "x", "int"), ("Part", 1, 1, "y", "int"), ("Part", 1, 2, "y", "int"), ("Part", 1, 3, "y", "time"), ("Part", 2, 4, "z", "int")]


@query(f"""WITH h(entity, generation, version, attribute, type) AS (VALUES {", ".join(map(str, HISTORY))})
SELECT a.entity, a.generation, a.attribute, a.version, b.version AS version_b, a.type, b.type AS type_b FROM h a JOIN h b ON a.entity = b.entity AND a.generation = b.generation AND a.attribute = b.attribute AND a.version < b.version AND a.type <> b.type""")
def g4_attribute_reuse(spark, d):
    return evolve.reused_attributes(spark.createDataFrame(HISTORY, "entity string, generation int, version int, attribute string, type string"))


@query("""WITH a AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey % 9 <> 0 AND (l_suppkey % 4 <> 0 OR l_linenumber > 2) GROUP BY 1)
SELECT coalesce(a.l_suppkey, b.l_suppkey) AS l_suppkey, a.n AS old_n, b.n AS new_n, CASE WHEN b.n IS NULL THEN 'removed' WHEN a.n IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b USING (l_suppkey) WHERE a.n IS NULL OR b.n IS NULL OR abs(b.n - a.n) > a.n * 0.1""")
def g7_diff(spark, d):
    line = table(spark, d, "lineitem")
    old, new = analysis.items_per_key(line, ["l_suppkey"]), analysis.items_per_key(line.filter("l_suppkey % 9 <> 0 and (l_suppkey % 4 <> 0 or l_linenumber > 2)"), ["l_suppkey"])
    return evolve.diff(old, new, ["l_suppkey"], ["n"], [])


FOUND_BEFORE = [("a", "X", "note", False), ("a", "X", "note", False), ("b", "Y", "note", False), ("d", "W", "note", False), ("e", "V", "note", True), ("f", "U", "error", False)]
FOUND_AFTER = [("a", "X", "note", False), ("b", "Y", "error", False), ("c", "Z", "note", False), ("d", "W", "note", True), ("e", "V", "note", False), ("f", "U", "error", False)]


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY rule, subject ORDER BY severity, accepted) AS nth FROM (VALUES {", ".join(map(str, FOUND_BEFORE))}) t(rule, subject, severity, accepted)),
n AS (SELECT *, row_number() OVER (PARTITION BY rule, subject ORDER BY severity, accepted) AS nth FROM (VALUES {", ".join(map(str, FOUND_AFTER))}) t(rule, subject, severity, accepted)),
c AS (SELECT coalesce(o.rule, n.rule) AS rule, coalesce(o.subject, n.subject) AS subject, CAST(coalesce(o.nth, n.nth) AS INT) AS nth,
  CASE WHEN o.rule IS NULL THEN 'new' WHEN n.rule IS NULL THEN 'resolved' WHEN o.severity <> n.severity THEN 'severity' WHEN n.accepted AND NOT o.accepted THEN 'accepted' WHEN o.accepted AND NOT n.accepted THEN 'unaccepted' END AS change
  FROM o FULL JOIN n ON o.rule = n.rule AND o.subject = n.subject AND o.nth = n.nth) SELECT * FROM c WHERE change IS NOT NULL""")
def g8_finding_diff(spark, d):
    kind = "rule string, subject string, severity string, accepted boolean"
    return evolve.finding_diff(spark.createDataFrame(FOUND_BEFORE, kind), spark.createDataFrame(FOUND_AFTER, kind))


@query("SELECT 'Order' AS entity, 150000.0::DOUBLE AS items, 75000.0::DOUBLE AS rru, 600000.0::DOUBLE AS wru")
def g9_migration_cost(spark, d):
    c = evolve.pass_cost(entity("Order"), 150000.0)
    return spark.createDataFrame([("Order", c["items"], c["rru"], c["wru"])], "entity string, items double, rru double, wru double")


def _rekeyed():
    e = entity("Line")
    return e, replace(e, version=2, sk=parse_template("LINE#{l_linenumber}"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS sources, 'same_key' AS conflict FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def m4_conflicts(spark, d):
    """Lines copied under a key of only order and number: several sources meet."""
    old, new = _rekeyed()
    bad = evolve.conflicts(evolve.converted(rows(spark, d, "Line"), old, new), new)
    return bad.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("sources"), F.first("conflict").alias("conflict"))


def _copied(spark, d):
    o = rows(spark, d, "Order").withColumn("_rev", (F.col("o_orderkey") % 3).cast("bigint"))
    e = entity("Order")
    conv = evolve.converted(o, e, e)
    return conv, conv.filter("o_orderkey % 4 <> 0").withColumn("src_rev", F.expr("case when o_orderkey % 10 = 1 then src_rev - 1 else src_rev end"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 10 = 1")
def m2_catch_up(spark, d):
    """What a further pass copies: rows that aren't there, or are at an older revision."""
    source, copied = _copied(spark, d)
    return evolve.to_copy(source, copied).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 6 = 0")
def m3_stale(spark, d):
    source, copied = _copied(spark, d)
    return evolve.stale(copied, source.filter("o_orderkey % 6 <> 0"), entity("Order").key_fields).select("o_orderkey")


@query("SELECT count(*) FILTER (o_orderkey % 4 = 0 OR o_orderkey % 10 = 1) AS copied, count(*) FILTER (o_orderkey % 4 <> 0 AND o_orderkey % 10 <> 1) AS same FROM orders")
def m12_report(spark, d):
    return evolve.report(*_copied(spark, d))


@query("SELECT doc_id, len(list_distinct(string_split(text, ' '))) AS n FROM documents")
def m13_list_to_set(spark, d):
    """A list becomes a set when its entity is copied into one that says so."""
    e, _ = tagged(spark, d)
    old = Entity("Doc", (Field("doc_id", "int"), Field("source"), Field("tags", "string_list")), e.pk, e.sk)
    docs = table(spark, d, "documents").select("doc_id", "source", F.split("text", " ").alias("tags"))
    return evolve.converted(docs, old, e).select("doc_id", F.size("tags").cast("bigint").alias("n"))


def _named_parts():
    """Parts in a new generation that needs a type, and of which names are claimed."""
    old = entity("Part")
    return old, replace(old, version=2, fields=tuple(replace(f, required=f.name == "p_type") for f in old.fields))


@query("""WITH p AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r, p_type FROM part)
SELECT 'P#' || printf('%019d', p_partkey) AS src_pk, CASE WHEN p_type IS NULL OR p_type = '' THEN 'required' ELSE 'claim_taken' END AS conflict FROM p WHERE r > 1 OR p_type IS NULL OR p_type = ''""")
def m4_conflict_kinds(spark, d):
    """Why parts can't be copied: of those with one name only the first can."""
    old, new = _named_parts()
    source = evolve.converted(rows(spark, d, "Part"), old, new)
    return migrate.conflicts(source, source.limit(0), new).select("src_pk", "conflict")


@query("""WITH c AS (SELECT c_custkey AS k, c_name FROM customer), s AS (SELECT a.k, b.c_name AS c_name FROM c a JOIN c b ON b.k = CASE WHEN a.k % 2 = 1 THEN a.k + 1 ELSE a.k - 1 END)
SELECT old.k AS c_custkey FROM c old JOIN s mine ON mine.k = old.k JOIN s other ON other.c_name = old.c_name AND other.k <> old.k WHERE mine.c_name <> old.c_name""")
def m5_displaced(spark, d):
    """Customers of odd and even keys have swapped names since they were copied: copies hold names that others claim."""
    e = entity("Customer")
    now = rows(spark, d, "Customer")
    partner = now.select(F.expr("case when c_custkey % 2 = 1 then c_custkey + 1 else c_custkey - 1 end").alias("c_custkey"), F.col("c_name").alias("_name"))
    swapped = now.join(partner, "c_custkey").withColumn("c_name", F.col("_name")).select(*now.columns)
    copied, source = evolve.converted(now, e, e), evolve.converted(swapped, e, e)
    gone = migrate.displaced(source, copied, e)
    return copied.join(gone, ["src_pk", "src_sk"], "left_semi").select("c_custkey")


def _migration(spark, d, name: str, progress: str | None = None):
    """Suppliers on their way to a shorter key, with copies as Parquet folders beside the checkpoints."""
    from keystrata.sources.store import scratch

    old = entity("Supplier")
    new = replace(old, version=2, sk=parse_template("S"))
    folder, n = scratch(spark, name), [0]
    evolve.converted(rows(spark, d, "Supplier"), old, new).limit(0).write.parquet(f"{folder}/0")

    def save(df: DataFrame) -> None:
        df.write.parquet(f"{folder}/{n[0] + 1}")
        n[0] += 1

    load = lambda: spark.read.parquet(f"{folder}/{n[0]}")
    return migrate.Migration(old, new, lambda: rows(spark, d, "Supplier"), load, save, lambda _: None, progress, segments=4), load


@query("SELECT s_suppkey, s_name FROM supplier WHERE ('0x' || substr(sha256('S#' || printf('%019d', s_suppkey)), 1, 8))::UBIGINT % 4 IN (1, 2)")
def m10_resume(spark, d):
    """A run that goes on from a checkpoint, which has one segment of four done, and stops after two more."""
    run, load = _migration(spark, d, "m10", migrate.Progress(4, done=[0]).text())
    run.bulk(most_segments=2)
    return load().select("s_suppkey", "s_name")


@query("SELECT s_suppkey, s_name, true AS finished FROM supplier")
def m8_finish(spark, d):
    """All segments, passes until nothing changes, and the last one."""
    run, load = _migration(spark, d, "m8")
    run.bulk()
    run.catch_up()
    run.finish()
    return load().select("s_suppkey", "s_name", F.lit(run.progress.finished).alias("finished"))


# --- streaming --------------------------------------------------------------------------------------------------------


def _stream(spark, d):
    return maintain.file_stream(spark, d, "events", table(spark, d, "events").schema)


@query("SELECT user_id, event_type, count(*) AS events FROM events GROUP BY ALL")
def st1_stream_counter(spark, d):
    from keystrata.sources.store import scratch

    return maintain.fold_counts(_stream(spark, d), ["user_id", "event_type"], scratch(spark, "st1"))


@query(f"SELECT user_id, count(*) AS events FROM events WHERE floor(epoch(ts))::BIGINT + 604800 > {NOW} GROUP BY 1")
def st3_ttl(spark, d):
    from keystrata.sources.store import scratch

    ev = _stream(spark, d).withColumn("expires", F.unix_timestamp(F.col("ts").cast("timestamp")) + 604800)
    return maintain.fold_counts(maintain.without_expired(ev, "expires", NOW), ["user_id"], scratch(spark, "st3"))


@query(f"SELECT user_id, event_type, count(*) AS counted, count(*) FILTER (floor(epoch(ts))::BIGINT + 604800 > {NOW} - 172800) AS kept FROM events GROUP BY ALL")
def st3_sweep(spark, d):
    """Rows go two days after they expired; the counters that they fed stay as they were."""
    e, ev = entity("Event"), rows(spark, d, "Event")
    counted = derive.counters_by_field(ev, e, e.counter("Types")).withColumnRenamed("events", "counted")
    left = derive.counters_by_field(maintain.swept(ev, "expires", NOW, 172_800), e, e.counter("Types")).withColumnRenamed("events", "kept")
    return counted.join(left, ["user_id", "event_type"], "left").select("user_id", "event_type", "counted", F.coalesce("kept", F.lit(0)).alias("kept"))


@query("SELECT event_id, user_id FROM events")
def st4_catch_up(spark, d):
    from keystrata.sources.store import scratch

    return maintain.run_to_end(_stream(spark, d).select("event_id", "user_id"), scratch(spark, "st4"), "append").select("event_id", "user_id")




# --- what the driver knows of a design, as frames ---------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('Customer', 'Close', 'delete_read'), ('Customer', 'Open', 'put'), ('Customer', 'Rename', 'read_first'), ('Event', 'Record', 'put'), ('Order', 'Cancel', 'delete_read'), ('Order', 'Close', 'read_first'), ('Order', 'Note', 'single'), ('Order', 'Place', 'put'), ('Order', 'Reprice', 'read_first'), ('Part', 'Add', 'put')) t(entity, write, shape)")
def w4_w5_write_shapes(spark, d):
    return spark.createDataFrame([(e.name, w.name, planner.write_shape(e, w)) for e in design().entities for w in e.writes], "entity string, write string, shape string")


@query("SELECT * FROM (VALUES ('Cancel', NULL, false), ('Close', true, false), ('Note', NULL, NULL), ('Place', false, true), ('Reprice', NULL, NULL)) t(write, before, after)")
def p7_index_membership(spark, d):
    e = entity("Order")
    return spark.createDataFrame([(w.name, *planner.members(e, e.index("Open"), w)) for w in e.writes], "write string, before boolean, after boolean")


@query("""WITH v(i, v) AS (VALUES (0, 'F'), (1, 'O'), (2, 'P'), (3, '')), p(pred, given, negate) AS (VALUES ('F', ['F'], false), ('not F', ['F'], true), ('F or O', ['F', 'O'], false))
SELECT pred, string_agg(v, ',' ORDER BY i) AS allowed FROM p, v WHERE list_contains(given, v) <> negate GROUP BY pred""")
def p5_allowed_values(spark, d):
    f = entity("Order").field("o_orderstatus")
    preds = {"F": Pred("o_orderstatus", ("F",)), "not F": Pred("o_orderstatus", ("F",), True), "F or O": Pred("o_orderstatus", ("F", "O"))}
    return spark.createDataFrame([(n, planner.allowed_values(f, p)) for n, p in preds.items()], "pred string, allowed string")


@query(_raw() + """, k AS (SELECT entity, unnest(list_distinct(regexp_extract_all(pk || sk, '[{]([a-z_]+)', 1))) AS theirs FROM e),
m AS (SELECT a.entity, k.entity AS target, k.theirs, coalesce(max(own.field), max(ref.field)) AS ours FROM e a JOIN k ON k.entity <> a.entity LEFT JOIN f own ON own.entity = a.entity AND own.field = k.theirs LEFT JOIN f ref ON ref.entity = a.entity AND ref.ref = k.entity GROUP BY ALL)
SELECT * FROM m WHERE (entity, target) NOT IN (SELECT (entity, target) FROM m WHERE ours IS NULL)""")
def j7_key_mapping(spark, d):
    out = [(e.name, t.name, a, b) for e in design().entities for t in design().entities if e is not t for a, b in planner.key_mapping(design(), e, t).items()]
    return spark.createDataFrame(out, "entity string, target string, theirs string, ours string")


@query(_raw() + " SELECT entity, ref AS target, 'ref' AS kind FROM f WHERE ref IS NOT NULL UNION SELECT entity, target, 'requires' FROM r UNION SELECT entity, per, 'volume' FROM e WHERE per IS NOT NULL")
def z16_relations(spark, d):
    return spark.createDataFrame(planner.relations(design()), "entity string, target string, kind string")


@query(_raw() + """, x AS (SELECT i, regexp_extract(pk, '^[^{]*') AS ph, regexp_extract(pk, '[^}]*$') AS pt, contains(pk, '{') AS pv, pk, regexp_extract(sk, '^[^{]*') AS sh, regexp_extract(sk, '[^}]*$') AS st, contains(sk, '{') AS sv, sk FROM e),
o AS (SELECT CASE WHEN a.pv AND b.pv THEN left(a.ph, least(len(a.ph), len(b.ph))) = left(b.ph, least(len(a.ph), len(b.ph))) AND right(a.pt, least(len(a.pt), len(b.pt))) = right(b.pt, least(len(a.pt), len(b.pt))) ELSE a.pk = b.pk END
 AND CASE WHEN a.sv AND b.sv THEN left(a.sh, least(len(a.sh), len(b.sh))) = left(b.sh, least(len(a.sh), len(b.sh))) AND right(a.st, least(len(a.st), len(b.st))) = right(b.st, least(len(a.st), len(b.st)))
  WHEN a.sv THEN starts_with(b.sk, a.sh) AND ends_with(b.sk, a.st) WHEN b.sv THEN starts_with(a.sk, b.sh) AND ends_with(a.sk, b.st) ELSE a.sk = b.sk END AS equal FROM x a JOIN x b ON a.i < b.i)
SELECT count(*) AS pairs, count(*) FILTER (equal) AS overlapping FROM o""")
def k4_k5_overlaps(spark, d):
    pairs = spark.createDataFrame(planner.overlaps(design()), "a string, b string, equal boolean, prefix boolean")
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("equal").alias("overlapping"))


@query(_raw() + " SELECT e.entity, CASE WHEN ttl IS NOT NULL OR bool_or(kind = 'delete') THEN 'bounded' WHEN bool_or(kind = 'create') THEN 'grows' ELSE 'fixed' END AS growth FROM e LEFT JOIN w USING (entity) GROUP BY e.entity, ttl")
def z21_growth(spark, d):
    return spark.createDataFrame([(e.name, analysis.growth(e)) for e in design().entities], "entity string, growth string")


@query(_raw() + " SELECT entity || ': ' || string_agg(field, ', ') || ' is unique' AS guarantee FROM u GROUP BY entity, name UNION ALL SELECT entity || ': ' || field || ' is never empty' FROM f WHERE required UNION ALL SELECT entity || '.' || write || ' needs a ' || target FROM r")
def z28_guarantees(spark, d):
    return spark.createDataFrame([(g,) for e in design().entities for g in analysis.guarantees(e)], "guarantee string")


STEPS = [(10.0, 50.0), (20.0, 60.0), (3.0, 4.0)]


@query(f"WITH s(t, m) AS (VALUES {', '.join(map(str, STEPS))}) SELECT CAST(product(t) AS DOUBLE) AS typical, CAST(max((SELECT product(t) FROM s) / t * m) AS DOUBLE) AS most FROM s")
def z18_chained_skew(spark, d):
    return spark.createDataFrame([planner.chained_skew(STEPS)], "typical double, most double")


@query("SELECT o_custkey, least(5.0, greatest(1, ceil(count(*) * 571 / 4096.0)) * 0.5)::DOUBLE AS rru FROM orders GROUP BY 1")
def z25_read_capping(spark, d):
    per = analysis.items_per_key(table(spark, d, "orders"), ["o_custkey"])
    return per.select("o_custkey", cost.capped_read_units(F.lit(5.0), F.col("n"), 571).cast("double").alias("rru"))


@query("SELECT doc_id, greatest(1, ceil(strlen(text) / 20.0))::BIGINT AS declared, len(list_distinct(string_split(text, ' ')))::BIGINT AS held FROM documents")
def z11_set_elements(spark, d):
    e, docs = tagged(spark, d)
    size = table(spark, d, "documents").select("doc_id", cost.estimated_elements(F.octet_length("text")).alias("declared"))
    return size.join(docs.select("doc_id", cost.held_elements("tags").alias("held")), "doc_id")


@query("SELECT n::INT AS per_write, greatest(1, 100 // n)::BIGINT AS size FROM range(1, 201) t(n)")
def w26_batch_size(spark, d):
    return spark.createDataFrame([(n, writes.batch_size(n)) for n in range(1, 201)], "per_write int, size long")


@query("SELECT i::INT AS attempt, least(0.005 * 2 ** i, 0.25)::DOUBLE AS seconds FROM range(0, 7) t(i)")
def w24_retry(spark, d):
    return spark.createDataFrame(list(enumerate(writes.waits([1.0] * 8))), "attempt int, seconds double")


SIZES = ["64KB", "1MB", "10", "1.5GB", "0.25KB", "7B"]


@query(f"""SELECT t AS text, CAST(CAST(regexp_extract(t, '^[0-9.]+') AS DOUBLE) * CASE regexp_extract(t, '[A-Z]+$') WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576 WHEN 'GB' THEN 1073741824 ELSE 1 END AS BIGINT) AS bytes FROM (SELECT unnest({SIZES}) AS t)""")
def z33_sizes(spark, d):
    return spark.createDataFrame([(t, analysis.parse_size(t)) for t in SIZES], "text string, bytes long")


@query("SELECT conv_id, turn, 'CONV#' || printf('%019d', conv_id) AS PK FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = c.conv_id AND a.turn + a.conv_id % 2 = c.turn)")
def r2_get_many(spark, d):
    """Items for a frame of keys, of which some don't exist and some come twice."""
    e = entity("Turn")
    asked = rows(spark, d, "Turn").select("conv_id", (F.col("turn") + F.col("conv_id") % 2).alias("turn"))
    return reads.get_many(rows(spark, d, "Turn"), e, asked.unionByName(asked)).select("conv_id", "turn", K.render(e.pk, e).alias("PK"))


@query("SELECT user_id, min(ts) AS _created, max(ts) AS _updated FROM events GROUP BY 1")
def r26_timestamps(spark, d):
    return writes.stamps(table(spark, d, "events"), ["user_id"], "ts")


@query("SELECT DISTINCT o_custkey, o_orderdate FROM orders")
def d8_distinct_keys(spark, d):
    return derive.distinct_keys(table(spark, d, "orders"), ["o_custkey", "o_orderdate"])


@query("SELECT a.c_custkey, (a.c_name, a.c_nationkey) IS NOT DISTINCT FROM (b.c_name, b.c_nationkey) AS same FROM customer a JOIN (SELECT * REPLACE (CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey) FROM customer) b USING (c_custkey)")
def d7_item_equality(spark, d):
    c = rows(spark, d, "Customer")
    moved = c.withColumn("c_nationkey", F.expr("case when c_custkey % 3 = 0 then c_nationkey + 1 else c_nationkey end"))
    return derive.same_items(c, moved, ["c_custkey"], ["c_name", "c_nationkey"])


@query("SELECT o_orderkey, o_orderkey % 4 <> 0 AS has_copy FROM orders")
def j8_source_of_copies(spark, d):
    return evolve.with_copies(*_copied(spark, d)).select("o_orderkey", "has_copy")


@query("SELECT window_start, event_type, count(*) AS events FROM (SELECT date_trunc('day', ts) AS window_start, event_type FROM events) GROUP BY ALL")
def st2_materialised_view(spark, d):
    """An index that lags: daily counts as the last micro-batch has them."""
    from keystrata.sources.store import scratch

    days = _stream(spark, d).withColumn("window_start", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return maintain.fold_counts(days, ["window_start", "event_type"], scratch(spark, "st2"))


@query("SELECT * FROM (SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def st2_finished_windows(spark, d):
    """Daily counts once the watermark, two hours behind the latest event, has passed their day."""
    from keystrata.sources.store import scratch

    counts = maintain.windowed_counts(_stream(spark, d), "ts", ["event_type"], "1 day", "2 hours")
    done = maintain.run_to_end(counts, scratch(spark, "st2w"), "append")
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events")


@query(_shape_sql("SELECT x.c AS name, CASE WHEN count(d.c) = 0 THEN 'unchanged' WHEN bool_and(d.compatible) THEN 'new_version' ELSE 'new_generation' END AS state FROM (SELECT DISTINCT c FROM s) x LEFT JOIN d USING (c) GROUP BY x.c"))
def g5_apply_versions(spark, d):
    """What each case asks for: nothing, a new version or a new generation."""
    out = []
    for name, was, now in _shape_cases():
        old, new = ({(part, n): x for part, n, x in side} for side in (was, now))
        differ = [k for k in old.keys() | new.keys() if old.get(k) != new.get(k)]
        out.append((name, evolve.needed(old, new) if differ else "unchanged"))
    return spark.createDataFrame(out, "name string, state string")


@query(_raw() + """, new AS (SELECT field, CASE WHEN field = 's_nationkey' THEN 'string' ELSE type END AS type, required FROM f WHERE entity = 'Supplier' UNION ALL VALUES ('s_code', 'string', true), ('s_note', 'string', false))
SELECT new.field FROM new LEFT JOIN f ON f.entity = 'Supplier' AND f.field = new.field WHERE f.field IS NULL AND new.required OR f.type <> new.type""")
def g6_conversion_gaps(spark, d):
    e = entity("Supplier")
    fields = tuple(replace(f, type="string") if f.name == "s_nationkey" else f for f in e.fields)
    new = replace(e, fields=(*fields, Field("s_code", required=True), Field("s_note")))
    return spark.createDataFrame([(x,) for x in evolve.conversion_gaps(e, new)], "field string")


@query()
def s10_physical_spec(spark, d):
    return spark.createDataFrame([(n, g["pk"], g["sk"], g["all"], ",".join(g["fields"])) for n, g in physical(design())["gsis"].items()], "gsi string, pk string, sk string, everything boolean, fields string")


@query()
def s11_s12_documents(spark, d):
    import json

    made = [("markdown", document.markdown(design())), ("snapshot", json.dumps(document.snapshot(design()))), ("terraform", document.terraform(design())), ("request", document.create_request(design()))]
    return spark.createDataFrame(made, "kind string, text string")


@query()
def g1_shapes(spark, d):
    return spark.createDataFrame([(e.name, *r) for e in design().entities for r in evolve.shape_rows(evolve.shape(e))], "entity string, part string, name string, definition string")
