"""The example store over the TPC-H-like tables, and reading its rows."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.model import Design, Entity, read_design

SCHEMA = {
    "version": 1,
    "table": {"name": "shop", "generation": 1},
    "workload": {"peak": 5},
    "entities": {
        "Customer": {
            "fields": {
                "c_custkey": "int", "c_name": {"type": "string", "size": "18/20", "required": True}, "c_nationkey": "int",
                "c_acctbal": "float", "c_mktsegment": {"type": "enum", "values": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]},
            },
            "key": {"pk": "C#{c_custkey}", "sk": "CUSTOMER"},
            "unique": {"Name": {"fields": ["c_name"]}},
            "counters": {"Segments": {"pk": "SEGMENTS", "sk": "SEG#{c_mktsegment}", "values": {"customers": "count"}}},
            "access": {"Get": {"get": "key", "freshness": "eventual", "rate": 20}, "ByName": {"get": {"unique": "Name"}, "rate": 5}},
            "writes": {"Open": "create", "Rename": {"patch": ["c_name"]}, "Close": "delete"},
            "volume": 15000,
        },
        "Order": {
            "fields": {
                "o_orderkey": "int", "o_custkey": {"type": "int", "ref": "Customer"}, "o_orderstatus": {"type": "enum", "values": ["F", "O", "P"]},
                "o_totalprice": "float", "o_orderdate": "time", "o_orderpriority": {"type": "string", "size": "10/15"}, "o_urgency": {"type": "string", "size": "8/15"},
            },
            "key": {"pk": "C#{o_custkey}", "sk": "ORDER#{o_orderdate}#{o_orderkey}"},
            "indexes": {
                "ByUrgency": {"pk": "URG#{o_urgency}", "sk": "{o_orderdate}#{o_orderkey}", "project": ["o_orderstatus"], "matches": 0.8},
                "Open": {"pk": "C#{o_custkey}#OPEN", "sk": "AT#{o_orderdate}#{o_orderkey}", "where": {"o_orderstatus": "O"}, "project": ["o_totalprice"], "strategy": "copy", "matches": 0.5},
            },
            "counters": {
                "CustomerOrders": {"pk": "C#{o_custkey}", "sk": "COUNTS", "values": {"orders": "count", "open": {"count": True, "where": {"o_orderstatus": "O"}}, "closed": {"count": True, "where": {"o_orderstatus": {"not": "O"}}}}},
                "StatusTotals": {"pk": "TOTALS", "sk": "ST#{o_orderstatus}", "shards": 8, "values": {"orders": "count"}},
            },
            "access": {
                "Get": {"get": "key", "rate": 10},
                "History": {"query": "key", "range": "o_orderdate", "page": 20, "freshness": "eventual", "rate": 5},
                "Latest": {"query": "key", "order": "desc", "page": 20, "freshness": "eventual", "rate": 2},
                "Urgent": {"query": "ByUrgency", "range": "o_orderdate", "page": 50, "rate": 1},
                "OpenOrders": {"query": "Open", "page": 20, "freshness": "immediate", "rate": 3},
                "Counts": {"counter": "CustomerOrders", "rate": 4},
                "Export": {"scan": True, "reason": "the nightly report reads every order"},
            },
            "writes": {
                "Place": {"create": True, "set": {"o_orderstatus": "O"}, "requires": {"Customer": {"key": {"c_custkey": "o_custkey"}}}, "rate": 2},
                "Close": {"set": {"o_orderstatus": "F"}, "when": {"o_orderstatus": "O"}, "rate": 2},
                "Reprice": {"update": ["o_totalprice"], "when": {"o_orderstatus": {"not": "F"}}, "rate": 1},
                "Note": {"patch": ["o_orderpriority"], "rate": 0.5},
                "Cancel": "delete",
            },
            "volume": {"per": "Customer", "typical": 10, "max": 30},
        },
        "Part": {
            "fields": {"p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "float"},
            "key": {"pk": "P#{p_partkey}", "sk": "PART"},
            "unique": {"PartName": {"fields": ["p_name"]}},
            "indexes": {"ByBrand": {"pk": "BRAND#{p_brand}", "sk": "{p_name|lower}#{p_partkey}", "project": ["p_retailprice"]}},
            "access": {"Get": "get", "Brand": {"query": "ByBrand", "page": 25}},
            "writes": {"Add": "create"},
            "volume": 20000,
        },
        "Supplier": {
            "fields": {"s_suppkey": "int", "s_name": "string", "s_nationkey": "int", "s_acctbal": "float"},
            "key": {"pk": "S#{s_suppkey}", "sk": "SUPPLIER"},
            "access": {"Get": "get"},
            "volume": 1000,
        },
        "Line": {
            "fields": {
                "l_orderkey": "int", "l_linenumber": "int", "l_partkey": {"type": "int", "ref": "Part"}, "l_suppkey": {"type": "int", "ref": "Supplier"}, "l_quantity": "float",
                "l_extendedprice": "float", "l_discount": "float", "l_tax": "float", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "time",
            },
            "key": {"pk": "O#{l_orderkey}", "sk": "LINE#{l_linenumber}#{l_partkey}#{l_suppkey}"},
            "access": {"OfOrder": {"query": "key", "page": 50}},
            "volume": {"per": "Order", "typical": 4, "max": 20},
        },
        "Event": {
            "fields": {"event_id": "int", "ts": "time", "user_id": "int", "event_type": "string", "value": "float", "props": "string", "expires": "time"},
            "key": {"pk": "U#{user_id}", "sk": "EV#{ts}#{event_id}"},
            "ttl": "expires",
            "counters": {"Types": {"pk": "U#{user_id}", "sk": "TYPE#{event_type}", "values": {"events": "count"}}},
            "access": {"Recent": {"query": "key", "order": "desc", "page": 10}},
            "writes": {"Record": "create"},
        },
        "Turn": {
            "fields": {"conv_id": "int", "turn": "int", "role": {"type": "string", "size": "6/9"}, "text": {"type": "string", "size": "400/9000"}},
            "key": {"pk": "CONV#{conv_id}", "sk": "TURN#{turn}"},
            "access": {"Read": {"query": "key", "page": 50}},
        },
    },
}

TABLES = {"Customer": "customer", "Order": "orders", "Part": "part", "Supplier": "supplier", "Line": "lineitem", "Event": "events", "Turn": "conversations"}
EXPIRES_AFTER = 7 * 86400


@lru_cache
def design() -> Design:
    return read_design(SCHEMA)


def entity(name: str) -> Entity:
    return design().entity(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An entity's rows in its declared fields. Optional ones are made from the tables' own columns: an order has no urgency
    where its priority is low; an event expires a week after it happened."""
    df = table(spark, sf_dir, TABLES[name])
    if name == "Order":
        df = df.withColumn("o_urgency", F.expr("nullif(o_orderpriority, '5-LOW')"))
    if name == "Event":
        df = df.withColumn("expires", (F.unix_timestamp(F.col("ts").cast("timestamp")) + EXPIRES_AFTER).cast("bigint"))
    return df.select(*(f.name for f in entity(name).fields))
