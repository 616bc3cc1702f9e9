"""The layout engine's queries over the driver's tables, each with its SQL.

Tables are lifted to quads (one subject a row, one property a column) and read back through
a layout, so plain SQL over the tables says what must come out. Every query runs over its
whole tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shapeloom.functions import regexp
from shapeloom.functions.terms import RDF_NIL, XSD, lang_literal_col, parse_term, resolve
from shapeloom.operators.dehydrate import dehydrate, dehydrate_rows
from shapeloom.operators.hydrate import hydrate
from shapeloom.operators.match import GRAPH, match, match_unique, quad_set
from shapeloom.plans.builder import U8, Id, layout, prop
from shapeloom.plans.layouts import Call, Layouts, prelude
from shapeloom.plans.schema import to_ddl, to_spark_type, type_name
from shapeloom.shared import file_system, shared_path
from shapeloom.sources import cbor, nquads, trees
from shapeloom.sources.lift import BASE, lift, link, subject, table_layout
from shapeloom.streaming.quads import dehydrate_stream, hydrate_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def compiled(document: Any) -> tuple[Layouts, str]:
    layouts = Layouts()
    ref = layouts.add(document)
    return layouts.chain(prelude()), ref


def term(name: str) -> str:
    return f"<{BASE}{name}>"


def roots(df: DataFrame, name: str, *keys: str) -> DataFrame:
    return df.select(F.concat(F.lit("<"), subject(name, *keys), F.lit(">")).alias("in0"))


def key_of(c: str = "in0", kind: str = "bigint") -> Column:
    """The number at the end of a row's IRI."""
    return F.regexp_extract(c, r"/([0-9]+)>$", 1).cast(kind)


def field(name: str, kind: str = "string", datatype: str = "string", required: bool = False) -> dict:
    return {"value": {"type": kind, "datatype": XSD + datatype}, "property": BASE + name, "required": required}


def record(**fields: Any) -> dict:
    return {"type": "record", "fields": fields}


NAME = {"value": {"type": "string"}}
INT, LONG, DEC = ("number", "int"), ("number", "long"), ("number", "decimal")

# Records.


def nation_quads(spark, sf):
    return lift(table(spark, sf, "nation"), "nation", ["n_nationkey"], ["n_nationkey", "n_name", "n_regionkey"])


_IRI = f"'<{BASE}nation/' || n_nationkey || '>'"
_NATION_QUADS = " UNION ALL ".join(
    f"SELECT {_IRI} AS s, '<{BASE}{c}>' AS p, {o} AS o FROM nation"
    for c, o in (("n_name", "'\"' || n_name || '\"'"), ("n_nationkey", f"'\"' || n_nationkey || '\"^^<{XSD}int>'"), ("n_regionkey", f"'\"' || n_regionkey || '\"^^<{XSD}int>'"))
)


@query(_NATION_QUADS)
def dehydrate_record(spark, sf):
    return nation_quads(spark, sf).select("s", "p", "o")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def hydrate_record(spark, sf):
    layouts, ref = compiled(record(n_nationkey=field("n_nationkey", *INT), n_name=field("n_name"), n_regionkey=field("n_regionkey", *INT)))
    return hydrate(layouts, ref, nation_quads(spark, sf), roots(table(spark, sf, "nation"), "nation", "n_nationkey")).select("value.*")


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS o_orderdate, o_orderpriority FROM orders")
def round_trip_orders(spark, sf):
    orders = table(spark, sf, "orders")
    quads = lift(orders, "order", ["o_orderkey"], ORDER_COLUMNS)
    layouts, ref = compiled(table_layout(orders.schema, ORDER_COLUMNS, required=True, id_field=None))
    out = hydrate(layouts, ref, quads, roots(orders, "order", "o_orderkey")).select("value.*")
    return out.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


def place_quads(spark, sf):
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    out = lift(customer, "customer", ["c_custkey"], ["c_name"]).unionByName(link(customer, "customer", ["c_custkey"], "inNation", "nation", ["c_nationkey"]))
    out = out.unionByName(lift(nation, "nation", ["n_nationkey"], ["n_name"])).unionByName(link(nation, "nation", ["n_nationkey"], "inRegion", "region", ["n_regionkey"]))
    return out.unionByName(lift(region, "region", ["r_regionkey"], ["r_name"]))


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def hydrate_nested_record(spark, sf):
    region = {"id": BASE + "Region"} | record(r_name=field("r_name"))
    nation = record(n_name=field("n_name"), region={"value": region, "property": BASE + "inRegion"})
    layouts, ref = compiled(record(c_name=field("c_name"), nation={"value": nation, "property": BASE + "inNation"}))
    out = hydrate(layouts, ref, place_quads(spark, sf), roots(table(spark, sf, "customer"), "customer", "c_custkey"), mode="dropmalformed")
    return out.select(key_of().alias("c_custkey"), "value.c_name", F.col("value.nation.n_name").alias("n_name"), F.col("value.nation.region.r_name").alias("r_name"))


def rich_quads(spark, sf):
    """Customers; a balance only if it's positive."""
    rows = table(spark, sf, "customer").withColumn("balance", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return lift(rows, "customer", ["c_custkey"], ["c_name", "balance"])


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance, c_acctbal > 0 AS present FROM customer")
def hydrate_optional_field(spark, sf):
    layouts, ref = compiled(record(c_name=field("c_name"), balance=field("balance", *DEC)))
    out = hydrate(layouts, ref, rich_quads(spark, sf), roots(table(spark, sf, "customer"), "customer", "c_custkey"))
    return out.select(key_of().alias("c_custkey"), "value.c_name", F.col("value.balance").cast("double").alias("balance"), F.col("json").contains('"balance":').alias("present"))


@query("SELECT CASE WHEN c_acctbal > 0 THEN 'OK' ELSE 'MISSING_REQUIRED' END AS status, count(*) AS n FROM customer GROUP BY 1")
def hydrate_required_missing(spark, sf):
    layouts, ref = compiled(record(c_name=field("c_name"), balance=field("balance", *DEC, required=True)))
    out = hydrate(layouts, ref, rich_quads(spark, sf), roots(table(spark, sf, "customer"), "customer", "c_custkey"))
    return out.groupBy(F.coalesce("status", F.lit("OK")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'OK' ELSE 'MISSING_REQUIRED' END AS status FROM customer WHERE c_acctbal > 0")
def mode_dropmalformed(spark, sf):
    layouts, ref = compiled(record(balance=field("balance", *DEC, required=True)))
    out = hydrate(layouts, ref, rich_quads(spark, sf), roots(table(spark, sf, "customer"), "customer", "c_custkey"), mode="dropmalformed")
    return out.select(key_of().alias("c_custkey"), F.coalesce("status", F.lit("OK")).alias("status"))


# Graph patterns.


def frames_of(spark) -> DataFrame:
    return spark.range(1).select(F.lit("").alias(GRAPH))


def placed(spark, sf):
    return quad_set(place_quads(spark, sf))


@query("SELECT c_custkey, CASE count(o_orderkey) WHEN 0 THEN 'MISSING_DATA' WHEN 1 THEN 'OK' ELSE 'DATA_AMBIGUITY' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def unique_ambiguity_status(spark, sf):
    quads = quad_set(link(table(spark, sf, "orders"), "order", ["o_orderkey"], "by", "customer", ["o_custkey"]))
    frames = roots(table(spark, sf, "customer"), "customer", "c_custkey").select(F.lit("").alias(GRAPH), F.col("in0").alias("_0"))
    out = match_unique(quads, frames, ((1, term("by"), 0, None),), 1, 1)
    return out.select(key_of("_0").alias("c_custkey"), F.coalesce("status", F.lit("OK")).alias("status"))


@query("SELECT c_custkey, n_nationkey::BIGINT AS n_nationkey, n_regionkey::BIGINT AS n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def bgp_join_chain(spark, sf):
    out = match(placed(spark, sf), frames_of(spark), ((0, term("inNation"), 1, None), (1, term("inRegion"), 2, None)))
    return out.select(key_of("_0").alias("c_custkey"), key_of("_1").alias("n_nationkey"), key_of("_2").alias("n_regionkey"))


def part_quads(spark, sf, *columns):
    return lift(table(spark, sf, "part"), "part", ["p_partkey"], list(columns))


@query("SELECT p_partkey, '\"' || p_brand || '\"' AS brand, '\"' || p_type || '\"' AS type FROM part WHERE p_size = 11")
def bgp_star(spark, sf):
    quads = quad_set(part_quads(spark, sf, "p_brand", "p_type", "p_size"))
    out = match(quads, frames_of(spark), ((0, term("p_brand"), 1, None), (0, term("p_type"), 2, None), (0, term("p_size"), f'"11"^^<{XSD}int>', None)))
    return out.select(key_of("_0").alias("p_partkey"), F.col("_1").alias("brand"), F.col("_2").alias("type"))


@query("SELECT DISTINCT o_custkey AS c, l_suppkey AS s, c_nationkey::BIGINT AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey = s_nationkey")
def bgp_triangle(spark, sf):
    buys = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey")
    # Keys are dealt out by the subject made of them, so the join by subject needs no shuffle of terms. Repeated quads
    # only repeat matches, and these are made distinct, where one in 25 is left.
    buys = buys.repartition(F.concat(F.lit("<"), subject("customer", "o_custkey"), F.lit(">")))
    quads = link(buys, "customer", ["o_custkey"], "buysFrom", "supplier", ["l_suppkey"])
    quads = quads.unionByName(link(table(spark, sf, "customer"), "customer", ["c_custkey"], "inNation", "nation", ["c_nationkey"]))
    quads = quads.unionByName(link(table(spark, sf, "supplier"), "supplier", ["s_suppkey"], "inNation", "nation", ["s_nationkey"]))
    out = match(quad_set(quads), frames_of(spark), ((0, term("buysFrom"), 1, None), (0, term("inNation"), 2, None), (1, term("inNation"), 2, None)))
    return out.select("_0", "_1", "_2").distinct().select(key_of("_0").alias("c"), key_of("_1").alias("s"), key_of("_2").alias("n"))


@query("SELECT '\"' || a.r_name || '\"' AS a, '\"' || b.r_name || '\"' AS b FROM region a, region b")
def bgp_cross(spark, sf):
    quads = quad_set(lift(table(spark, sf, "region"), "region", ["r_regionkey"], ["r_name"]))
    return match(quads, frames_of(spark), ((0, term("r_name"), 1, None), (2, term("r_name"), 3, None))).select(F.col("_1").alias("a"), F.col("_3").alias("b"))


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey = l_suppkey")
def bgp_repeated_variable(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    quads = quad_set(link(pairs, "node", ["l_partkey"], "with", "node", ["l_suppkey"]))
    return match(quads, frames_of(spark), ((0, term("with"), 0, None),)).select(key_of("_0").alias("k"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_regionkey = 1")
def bgp_constant_object(spark, sf):
    return match(placed(spark, sf), frames_of(spark), ((0, term("inRegion"), term("region/1"), None),)).select(key_of("_0").alias("n_nationkey"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#17'")
def bgp_constant_literal(spark, sf):
    return match(quad_set(part_quads(spark, sf, "p_brand")), frames_of(spark), ((0, term("p_brand"), '"Brand#17"', None),)).select(key_of("_0").alias("p_partkey"))


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src0'")
def lang_literal(spark, sf):
    docs = table(spark, sf, "documents")
    quads = docs.select(F.concat(F.lit("<"), subject("doc", "doc_id"), F.lit(">")).alias("s"), F.lit(term("source")).alias("p"), lang_literal_col(F.col("source"), F.col("lang")).alias("o"), F.lit(None).cast("string").alias("g"))
    layouts, ref = compiled({"type": "unit", "dataset": [["_:self", BASE + "source", {"value": "src0", "language": "fr"}]]})
    return hydrate(layouts, ref, quads, roots(docs, "doc", "doc_id"), mode="dropmalformed").select(key_of().alias("doc_id"))


# Lists.


def names_of(df: DataFrame, name: str) -> Column:
    return F.array_join(name, "|")


@query("SELECT r_regionkey::BIGINT AS r_regionkey, coalesce(string_agg(n_name, '|' ORDER BY n_name), '') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def hydrate_set(spark, sf):
    item = {"intro": ["nation", "name"], "dataset": [["_:nation", BASE + "inRegion", "_:self"], ["_:nation", BASE + "n_name", "_:name"]], "value": {"layout": {"type": "string"}, "input": "_:name"}}
    layouts, ref = compiled({"type": "set", "item": item})
    out = hydrate(layouts, ref, place_quads(spark, sf), roots(table(spark, sf, "region"), "region", "r_regionkey"), json=False)
    return out.select(key_of().alias("r_regionkey"), F.array_join("value", "|").alias("names"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, coalesce(string_agg(c_mktsegment, '|' ORDER BY c_mktsegment), '') AS segments FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def hydrate_set_duplicates(spark, sf):
    customer = table(spark, sf, "customer")
    quads = lift(customer, "customer", ["c_custkey"], ["c_mktsegment"]).unionByName(link(customer, "customer", ["c_custkey"], "inNation", "nation", ["c_nationkey"]))
    item = {"intro": ["customer", "segment"], "dataset": [["_:customer", BASE + "inNation", "_:self"], ["_:customer", BASE + "c_mktsegment", "_:segment"]], "value": {"layout": {"type": "string"}, "input": "_:segment"}}
    layouts, ref = compiled({"type": "set", "item": item})
    out = hydrate(layouts, ref, quads, roots(table(spark, sf, "nation"), "nation", "n_nationkey"), json=False)
    return out.select(key_of().alias("n_nationkey"), F.array_join("value", "|").alias("segments"))


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0)::DOUBLE, 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def hydrate_set_of_records(spark, sf):
    orders = table(spark, sf, "orders")
    quads = lift(orders, "order", ["o_orderkey"], ["o_totalprice", "o_orderstatus"]).unionByName(link(orders, "order", ["o_orderkey"], "by", "customer", ["o_custkey"]))
    item = {"intro": ["order"], "dataset": [["_:order", BASE + "by", "_:self"]], "value": {"layout": record(price=field("o_totalprice", *DEC), state=field("o_orderstatus")), "input": "_:order"}}
    layouts, ref = compiled({"type": "set", "item": item})
    out = hydrate(layouts, ref, quads, roots(table(spark, sf, "customer"), "customer", "c_custkey"), json=False)
    total = F.aggregate("value", F.lit(0).cast("decimal(38,18)"), lambda acc, x: (acc + x["price"]).cast("decimal(38,18)"))
    return out.select(key_of().alias("c_custkey"), F.size("value").cast("bigint").alias("n"), F.round(total.cast("double"), 2).alias("total"))


SET_OF_NAMES = record(id={"intro": [], "value": {"layout": {"type": "id"}, "input": "_:self"}}, names={"intro": [], "value": {"layout": {"type": "set", "item": {"value": {"type": "string"}, "property": BASE + "nation"}}, "input": "_:self"}})


@query(f"SELECT DISTINCT '<{BASE}region/' || n_regionkey || '>' AS s, '<{BASE}nation>' AS p, '\"' || n_name || '\"' AS o FROM nation")
def dehydrate_set(spark, sf):
    rows = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names")).select(subject("region", "n_regionkey").alias("id"), "names")
    layouts, ref = compiled(SET_OF_NAMES)
    return dehydrate(layouts, ref, rows, ["id"]).quads.select("s", "p", "o")


TUPLE = {"type": "tuple", "items": [{"value": {"type": "string"}, "property": BASE + "p_brand"}, {"value": {"type": "number", "datatype": XSD + "int"}, "property": BASE + "p_size"}, {"value": {"type": "number", "datatype": XSD + "decimal"}, "property": BASE + "p_retailprice"}]}


@query(f"SELECT '<{BASE}part/' || p_partkey || '>' AS s, '<{BASE}p_brand>' AS p, '\"' || p_brand || '\"' AS o FROM part UNION ALL SELECT '<{BASE}part/' || p_partkey || '>', '<{BASE}p_size>', '\"' || p_size || '\"^^<{XSD}int>' FROM part")
def dehydrate_tuple(spark, sf):
    rows = roots(table(spark, sf, "part"), "part", "p_partkey").select("in0")
    rows = table(spark, sf, "part").select(F.concat(F.lit("<"), subject("part", "p_partkey"), F.lit(">")).alias("iri"), F.struct(F.col("p_brand").alias("_0"), F.col("p_size").alias("_1")).alias("v"))
    layouts, ref = compiled({"type": "tuple", "items": TUPLE["items"][:2]})
    return dehydrate(layouts, ref, rows, ["iri"], value="v", inputs={0: "iri"}).quads.select("s", "p", "o")


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def hydrate_tuple(spark, sf):
    layouts, ref = compiled(TUPLE)
    out = hydrate(layouts, ref, part_quads(spark, sf, "p_brand", "p_size", "p_retailprice"), roots(table(spark, sf, "part"), "part", "p_partkey"))
    return out.select(key_of().alias("p_partkey"), F.col("value._0").alias("p_brand"), F.col("value._1").alias("p_size"), F.col("value._2").cast("double").alias("p_retailprice"))


TEXTS = {"type": "list", "node": {"type": "string"}}


def list_quads(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))).alias("texts"))
    rows = rows.select("conv_id", F.concat(F.lit("<"), subject("conv", "conv_id"), F.lit(">")).alias("iri"), "texts")
    layouts, ref = compiled(TEXTS)
    return dehydrate(layouts, ref, rows, ["conv_id"], value="texts", inputs={0: "iri"}).quads


@query(f"SELECT '<http://www.w3.org/1999/02/22-rdf-syntax-ns#first>' AS p, count(*) AS n, 0::BIGINT AS ends FROM conversations UNION ALL SELECT '<http://www.w3.org/1999/02/22-rdf-syntax-ns#rest>', count(*), count(DISTINCT conv_id) FROM conversations")
def dehydrate_list(spark, sf):
    ends = F.sum(F.when(F.col("o") == f"<{RDF_NIL}>", 1).otherwise(0))
    return list_quads(spark, sf).groupBy("p").agg(F.count(F.lit(1)).alias("n"), ends.alias("ends"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS texts, count(*) AS n FROM conversations GROUP BY conv_id")
def hydrate_ordered_list(spark, sf):
    layouts, ref = compiled(TEXTS)
    heads = roots(table(spark, sf, "conversations").select("conv_id").distinct(), "conv", "conv_id")
    out = hydrate(layouts, ref, list_quads(spark, sf), heads, json=False)
    return out.select(key_of().alias("conv_id"), F.array_join("value", "\n").alias("texts"), F.size("value").cast("bigint").alias("n"))


@query("SELECT text AS text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations")
def list_node_links(spark, sf):
    quads = quad_set(list_quads(spark, sf))
    first, rest = (f"<http://www.w3.org/1999/02/22-rdf-syntax-ns#{x}>" for x in ("first", "rest"))
    nodes = match(quads, frames_of(spark), ((0, first, 1, None), (0, rest, 2, None))).select("_1", "_2")
    texts = quads.where(F.col("p") == first).select(F.col("s").alias("_2"), F.col("o").alias("next"))
    from shapeloom.functions.terms import XSD_STRING, text_of, unescape_col

    plain = lambda c: unescape_col(text_of(F.col(c), XSD_STRING))
    return nodes.join(texts, "_2", "left").select(plain("_1").alias("text"), F.when(F.col("next").isNotNull(), plain("next")).alias("next"))


# Sums.


def event_quads(spark, sf):
    """An event's value is a number for purchases and the event's type, a text, for others;
    errors have neither."""
    events = table(spark, sf, "events")
    buys = lift(events.where("event_type = 'purchase'").select("event_id", F.col("value").alias("payload")), "event", ["event_id"], ["payload"])
    rest = lift(events.where("event_type NOT IN ('purchase', 'error')").select("event_id", F.col("event_type").alias("payload")), "event", ["event_id"], ["payload"])
    return buys.unionByName(rest)


PAYLOAD = {"type": "sum", "variants": {"number": {"value": {"type": "number", "datatype": XSD + "decimal"}}, "text": {"value": {"type": "string"}}}}


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 0 WHEN event_type <> 'error' THEN 1 END AS tag, CASE WHEN event_type = 'purchase' THEN value END AS number, CASE WHEN event_type NOT IN ('purchase', 'error') THEN event_type END AS text FROM events")
def hydrate_sum_literal(spark, sf):
    layouts, ref = compiled(record(payload={"value": PAYLOAD, "property": BASE + "payload"}))
    out = hydrate(layouts, ref, event_quads(spark, sf), roots(table(spark, sf, "events"), "event", "event_id")).select("in0", "value.payload.*")
    return out.select(key_of().alias("event_id"), "tag", F.col("number").cast("double").alias("number"), "text")


def kind_quads(spark, sf):
    events = table(spark, sf, "events").withColumn("kind", F.concat(F.lit("kind/"), F.col("event_type")))
    typed = events.select(F.concat(F.lit("<"), subject("event", "event_id"), F.lit(">")).alias("s"), F.lit(term("type")).alias("p"), F.concat(F.lit(f"<{BASE}"), F.col("kind"), F.lit(">")).alias("o"), F.lit(None).cast("string").alias("g"))
    return lift(events, "event", ["event_id"], ["value", "user_id"]).unionByName(typed)


def _kind(name: str, value: Any) -> dict:
    return {"dataset": [["_:self", BASE + "type", f"{BASE}kind/{name}"]], "value": value}


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'OK' WHEN 'purchase' THEN 'OK' ELSE 'NO_VARIANT' END AS status, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 0 END AS tag, CASE WHEN event_type = 'purchase' THEN value END AS amount, CASE WHEN event_type = 'click' THEN user_id END AS user_id FROM events")
def hydrate_sum_record(spark, sf):
    layouts, ref = compiled({"type": "sum", "variants": {"buy": _kind("purchase", record(amount=field("value", *DEC))), "click": _kind("click", record(user_id=field("user_id", *LONG)))}})
    out = hydrate(layouts, ref, kind_quads(spark, sf), roots(table(spark, sf, "events"), "event", "event_id"))
    return out.select(key_of().alias("event_id"), F.coalesce("status", F.lit("OK")).alias("status"), "value.tag", F.col("value.buy.amount").cast("double").alias("amount"), F.col("value.click.user_id").alias("user_id"))


@query("SELECT CASE event_type WHEN 'purchase' THEN 'OK' WHEN 'error' THEN 'MISSING_REQUIRED' ELSE 'AMBIGUOUS_VARIANT' END AS status, count(*) AS n FROM events GROUP BY 1")
def sum_ambiguous_status(spark, sf):
    both = {"type": "sum", "variants": PAYLOAD["variants"] | {"word": {"value": {"type": "string"}}}}
    layouts, ref = compiled(record(payload={"value": both, "property": BASE + "payload", "required": True}))
    out = hydrate(layouts, ref, event_quads(spark, sf), roots(table(spark, sf, "events"), "event", "event_id"))
    return out.groupBy(F.coalesce("status", F.lit("OK")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE event_type WHEN 'purchase' THEN 'NO_VARIANT' ELSE 'OK' END AS status, count(*) AS n FROM events GROUP BY 1")
def sum_none_status(spark, sf):
    words = {"type": "sum", "variants": {"word": {"value": {"type": "string"}}}}
    layouts, ref = compiled(record(payload={"value": words, "property": BASE + "payload"}))
    out = hydrate(layouts, ref, event_quads(spark, sf), roots(table(spark, sf, "events"), "event", "event_id"))
    return out.groupBy(F.coalesce("status", F.lit("OK")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'OK' WHEN event_type = 'error' THEN 'NO_VARIANT' ELSE 'OK' END AS status, CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type <> 'error' THEN 1 ELSE 0 END::BIGINT AS quads FROM events")
def dehydrate_sum(spark, sf):
    v = F.struct(F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") != "error", 1).alias("tag"), F.col("value").cast("decimal(18,2)").alias("number"), F.col("event_type").alias("text"))
    rows = table(spark, sf, "events").select("event_id", F.struct(v.alias("payload")).alias("v"))
    layouts, ref = compiled(record(payload={"value": PAYLOAD, "property": BASE + "payload"}))
    out = dehydrate_rows(layouts, ref, rows, ["event_id"], value="v")
    return out.select("event_id", F.coalesce("status", F.lit("OK")).alias("status"), F.size("quads").cast("bigint").alias("quads"))


# Literals.


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey = 1 THEN 'there' END AS value, CASE WHEN n_regionkey = 1 THEN 'OK' ELSE 'MISSING_DATA' END AS status FROM nation")
def unit_const_match(spark, sf):
    layouts, ref = compiled({"type": "unit", "const": "there", "dataset": [["_:self", BASE + "inRegion", BASE + "region/1"]]})
    out = hydrate(layouts, ref, place_quads(spark, sf), roots(table(spark, sf, "nation"), "nation", "n_nationkey"))
    return out.select(key_of().alias("n_nationkey"), "value", F.coalesce("status", F.lit("OK")).alias("status"))


@query("SELECT page_id, url FROM pages")
def id_layout(spark, sf):
    pages = table(spark, sf, "pages")
    quads = pages.select(F.concat(F.lit("<"), subject("page", "page_id"), F.lit(">")).alias("s"), F.lit(term("url")).alias("p"), F.concat(F.lit("<"), F.col("url"), F.lit(">")).alias("o"), F.lit(None).cast("string").alias("g"))
    layouts, ref = compiled(record(url={"value": {"type": "id"}, "property": BASE + "url"}))
    return hydrate(layouts, ref, quads, roots(pages, "page", "page_id")).select(key_of().alias("page_id"), "value.url")


_CENTS = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"


@query(f"SELECT o_orderkey, rtrim(rtrim({_CENTS}, '0'), '.') AS lexical FROM orders")
def number_lexical(spark, sf):
    layouts, ref = compiled(record(price=field("o_totalprice", *DEC)))
    orders = table(spark, sf, "orders")
    out = hydrate(layouts, ref, lift(orders, "order", ["o_orderkey"], ["o_totalprice"]), roots(orders, "order", "o_orderkey"))
    return out.select(key_of().alias("o_orderkey"), F.regexp_extract("json", '"price":([^}]*)', 1).alias("lexical"))


@query("SELECT c_custkey, c_acctbal AS number, floor(c_acctbal)::BIGINT AS whole, c_acctbal < 0 AS negative FROM customer")
def number_integral_types(spark, sf):
    customer = table(spark, sf, "customer").withColumns({"whole": F.floor("c_acctbal").cast("bigint"), "negative": F.col("c_acctbal") < 0})
    layouts, ref = compiled(record(number=field("c_acctbal", *DEC), whole=field("whole", *LONG), negative=field("negative", "boolean", "boolean")))
    out = hydrate(layouts, ref, lift(customer, "customer", ["c_custkey"], ["c_acctbal", "whole", "negative"]), roots(customer, "customer", "c_custkey"))
    return out.select(key_of().alias("c_custkey"), F.col("value.number").cast("double").alias("number"), "value.whole", "value.negative")


@query("SELECT o_orderkey, o_orderstatus = 'O' AS open FROM orders")
def boolean_values(spark, sf):
    orders = table(spark, sf, "orders").withColumn("open", F.col("o_orderstatus") == "O")
    layouts, ref = compiled(record(open=field("open", "boolean", "boolean")))
    return hydrate(layouts, ref, lift(orders, "order", ["o_orderkey"], ["open"]), roots(orders, "order", "o_orderkey")).select(key_of().alias("o_orderkey"), "value.open")


def _bytes(spark, sf, datatype):
    rows = table(spark, sf, "part").select("p_partkey", subject("part", "p_partkey").alias("id"), F.col("p_brand").cast("binary").alias("raw"))
    layouts, ref = compiled(record(id={"intro": [], "value": {"layout": {"type": "id"}, "input": "_:self"}}, raw=field("raw", "bytes", datatype)))
    quads = dehydrate(layouts, ref, rows.select("id", "raw"), ["id"]).quads
    out = hydrate(layouts, ref, quads, roots(rows, "part", "p_partkey"))
    return out.select(key_of().alias("p_partkey"), F.lower(F.hex("value.raw")).alias("raw"))


@query("SELECT p_partkey, lower(hex(p_brand)) AS raw FROM part")
def bytes_hex(spark, sf):
    return _bytes(spark, sf, "hexBinary")


@query("SELECT p_partkey, lower(hex(p_brand)) AS raw FROM part")
def bytes_base64(spark, sf):
    return _bytes(spark, sf, "base64Binary")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'NO_MATCHING_LITERAL' WHEN o_orderstatus = 'P' THEN 'INVALID_LITERAL' ELSE 'OK' END AS status FROM orders")
def literal_statuses(spark, sf):
    """A literal of another datatype and one that is no number are different failures."""
    orders = table(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit('"1e3"^^<'), F.lit(XSD + "decimal>"))).when(F.col("o_orderstatus") == "F", F.concat(F.lit('"1"^^<'), F.lit(XSD + "integer>"))).otherwise(F.concat(F.lit('"+01.50"^^<'), F.lit(XSD + "decimal>")))
    quads = orders.select(F.concat(F.lit("<"), subject("order", "o_orderkey"), F.lit(">")).alias("s"), F.lit(term("x")).alias("p"), text.alias("o"), F.lit(None).cast("string").alias("g"))
    layouts, ref = compiled(record(x=field("x", *DEC)))
    return hydrate(layouts, ref, quads, roots(orders, "order", "o_orderkey")).select(key_of().alias("o_orderkey"), F.coalesce("status", F.lit("OK")).alias("status"))


# Graphs and inputs.


def graph_quads(spark, sf):
    nation = table(spark, sf, "nation")
    region = F.concat(F.lit("<"), subject("region", "n_regionkey"), F.lit(">"))
    s = F.concat(F.lit("<"), subject("nation", "n_nationkey"), F.lit(">"))
    names = nation.select(s.alias("s"), F.lit(term("n_name")).alias("p"), F.concat(F.lit('"'), F.col("n_name"), F.lit('"')).alias("o"), region.alias("g"))
    return names.unionByName(nation.select(s.alias("s"), F.lit(term("inGraph")).alias("p"), region.alias("o"), F.lit(None).cast("string").alias("g")))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey = 2 THEN n_name END AS n_name FROM nation")
def named_graph_scope(spark, sf):
    layouts, ref = compiled(record(n_name=field("n_name")))
    out = hydrate(layouts, ref, graph_quads(spark, sf), roots(table(spark, sf, "nation"), "nation", "n_nationkey"), graph=term("region/2"))
    return out.select(key_of().alias("n_nationkey"), "value.n_name")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def graph_from_variable(spark, sf):
    layouts, ref = compiled(record(inner={"intro": ["g"], "dataset": [["_:self", BASE + "inGraph", "_:g"]], "value": {"layout": record(n_name=field("n_name", required=True)), "input": "_:self", "graph": "_:g"}}))
    out = hydrate(layouts, ref, graph_quads(spark, sf), roots(table(spark, sf, "nation"), "nation", "n_nationkey"))
    return out.select(key_of().alias("n_nationkey"), F.col("value.inner.n_name").alias("n_name"))


@query("SELECT n_regionkey::BIGINT AS n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def graph_variable_in_quad(spark, sf):
    out = match(quad_set(graph_quads(spark, sf)), frames_of(spark), ((0, term("n_name"), 1, 2),))
    return out.groupBy(key_of("_2").alias("n_regionkey")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT '<{BASE}nation/' || n_nationkey || '>' AS s, '<{BASE}region/' || 3 || '>' AS g FROM nation")
def graph_on_write(spark, sf):
    nation = table(spark, sf, "nation").select(subject("nation", "n_nationkey").alias("id"), "n_name")
    layouts, ref = compiled(record(id={"intro": [], "value": {"layout": {"type": "id"}, "input": "_:self"}}, n_name=field("n_name")))
    return dehydrate(layouts, ref, nation, ["id"], graph=term("region/3"), graph_on_write=True).quads.select("s", "g")


@query("SELECT c_custkey, n_nationkey::BIGINT AS n_nationkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def multi_input_layout(spark, sf):
    """Every customer with its own nation: two inputs that belong together."""
    pairs = table(spark, sf, "customer").select(*(F.concat(F.lit("<"), subject(n, k), F.lit(">")).alias(c) for n, k, c in (("customer", "c_custkey", "in0"), ("nation", "c_nationkey", "in1"))))
    two = {"type": "record", "input": ["customer", "nation"], "fields": {"c_name": field("c_name"), "n_name": {"dataset": [["_:nation", BASE + "n_name", "_:value"]], "value": {"type": "string"}}}}
    layouts, ref = compiled(two)
    out = hydrate(layouts, ref, place_quads(spark, sf), pairs)
    return out.select(key_of("in0").alias("c_custkey"), key_of("in1").alias("n_nationkey"), "value.c_name", "value.n_name")


@query("SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def same_as_resources(spark, sf):
    """Two names of one resource: the nation's quads speak of region by another IRI."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    quads = lift(region, "region", ["r_regionkey"], ["r_name"]).unionByName(lift(nation, "nation", ["n_nationkey"], ["n_name"])).unionByName(link(nation, "nation", ["n_nationkey"], "inRegion", "area", ["n_regionkey"]))
    wrap = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    same = region.select(wrap(subject("area", "r_regionkey")).alias("term"), wrap(subject("region", "r_regionkey")).alias("resource"))
    layouts, ref = compiled(record(n_name=field("n_name"), region={"value": record(r_name=field("r_name", required=True)), "property": BASE + "inRegion"}))
    out = hydrate(layouts, ref, quads, roots(nation, "nation", "n_nationkey"), same_as=same)
    return out.select("value.region.r_name", "value.n_name")


# Statuses of writing.


@query("SELECT CASE WHEN n_regionkey = 0 THEN 'UNKNOWN_KEY' WHEN n_regionkey = 1 THEN 'MISSING_REQUIRED' ELSE 'OK' END AS status, count(*) AS n FROM nation GROUP BY 1")
def extra_key_status(spark, sf):
    v = F.struct(F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("n_name"), F.when(F.col("n_regionkey") == 0, F.lit("x")).alias("other"))
    rows = table(spark, sf, "nation").select("n_nationkey", v.alias("v"))
    layouts, ref = compiled(record(n_name=field("n_name", required=True)))
    out = dehydrate(layouts, ref, rows, ["n_nationkey"], value="v").inputs
    return out.groupBy(F.coalesce("status", F.lit("OK")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN n_nationkey = n_regionkey THEN 'OK' ELSE 'TERM_AMBIGUITY' END AS status, count(*) AS n FROM nation GROUP BY 1")
def term_ambiguity_status(spark, sf):
    ids = {"intro": [], "value": {"layout": {"type": "id"}, "input": "_:self"}}
    rows = table(spark, sf, "nation").select("n_nationkey", F.struct(subject("place", "n_nationkey").alias("a"), subject("place", "n_regionkey").alias("b")).alias("v"))
    layouts, ref = compiled(record(a=ids, b=ids))
    out = dehydrate(layouts, ref, rows, ["n_nationkey"], value="v").inputs
    return out.groupBy(F.coalesce("status", F.lit("OK")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'OK' ELSE 'INVALID_IRI' END AS status FROM nation")
def invalid_iri_status(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, subject("nation", "n_nationkey")).otherwise(F.lit("no iri")).alias("v"))
    layouts, ref = compiled({"type": "id"})
    return dehydrate(layouts, ref, rows, ["n_nationkey"], value="v").inputs.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.coalesce("status", F.lit("OK")).alias("status"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'null' AS anything, 'INCOMPATIBLE_LAYOUT' AS nothing FROM nation")
def always_never(spark, sf):
    at = roots(table(spark, sf, "nation"), "nation", "n_nationkey")
    always, never = (hydrate(*compiled(x), nation_quads(spark, sf), at) for x in (True, False))
    return always.join(never.select("in0", F.col("status").alias("nothing")), "in0").select(key_of().alias("n_nationkey"), F.col("json").alias("anything"), "nothing")


# Formats.


_LINES = f"SELECT s || ' ' || p || ' ' || o || ' .' AS line FROM ({_NATION_QUADS})"


@query(_LINES)
def nquads_write(spark, sf):
    path = shared_path(spark, "nquads")
    nquads.write_nquads(nation_quads(spark, sf), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


_DOC_TEXT = "coalesce(text, '')"


@query(f"SELECT doc_id, {_DOC_TEXT} AS text FROM documents")
def nquads_parse(spark, sf):
    """Whole texts through N-Quads lines, with all their line ends and quotes."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = shared_path(spark, "nquads")
    nquads.write_nquads(lift(docs, "doc", ["doc_id"], ["text"]), path)
    layouts, ref = compiled(record(text=field("text")))
    return hydrate(layouts, ref, nquads.read_nquads(spark, path), roots(docs, "doc", "doc_id")).select(key_of().alias("doc_id"), "value.text")


@query(f"SELECT DISTINCT s, p, o FROM ({_NATION_QUADS} UNION ALL {_NATION_QUADS})")
def convert_rdf_dedup(spark, sf):
    path = shared_path(spark, "nquads")
    quads = nation_quads(spark, sf)
    nquads.write_nquads(quads.unionByName(quads), path)
    return nquads.read_nquads(spark, path).select("s", "p", "o")


@query("""SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def json_write(spark, sf):
    layouts, ref = compiled(record(n_nationkey=field("n_nationkey", *INT), n_name=field("n_name"), n_regionkey=field("n_regionkey", *INT)))
    path = shared_path(spark, "json")
    trees.write_json(hydrate(layouts, ref, nation_quads(spark, sf), roots(table(spark, sf, "nation"), "nation", "n_nationkey")), path)
    return spark.read.text(path).select(F.col("value").alias("json"))


@query(f"SELECT event_id, '\"' || json_extract(props, '$.k')::INTEGER || '\"^^<{XSD}integer>' AS o FROM events")
def json_read(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("<"), subject("event", "event_id"), F.lit(">")).alias("iri"), F.parse_json("props").alias("v"))
    layouts, ref = compiled(record(k=field("k", "number", "integer")))
    return dehydrate(layouts, ref, rows, ["event_id"], value="v", inputs={0: "iri"}).quads.select(key_of("s").alias("event_id"), "o")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def cbor_round_trip(spark, sf):
    """Hydrated trees to CBOR, tagged where the layout says so, and back."""
    name = field("n_name")
    name["value"] = name["value"] | {"extra": {"https://example.org/cbor#tag": 42}}
    layouts, ref = compiled(record(n_name=name))
    out = hydrate(layouts, ref, nation_quads(spark, sf), roots(table(spark, sf, "nation"), "nation", "n_nationkey"))
    back = cbor.from_cbor(cbor.to_cbor(out, layouts, ref), "cbor", "key")
    return back.select(key_of("key").alias("n_nationkey"), F.variant_get("value", "$.n_name", "string").alias("n_name"))


@query("SELECT p_partkey, CASE WHEN regexp_full_match(p_brand, 'Brand#(1|2)[0-9]?') THEN 'OK' ELSE 'PATTERN_MISMATCH' END AS status FROM part")
def regex_pattern_filter(spark, sf):
    brand = field("p_brand")
    brand["value"]["pattern"] = "Brand#(1|2|1[0-9]|2[0-9])"
    layouts, ref = compiled(record(p_brand=brand))
    out = hydrate(layouts, ref, part_quads(spark, sf, "p_brand"), roots(table(spark, sf, "part"), "part", "p_partkey"), enforce_patterns=True)
    return out.select(key_of().alias("p_partkey"), F.coalesce("status", F.lit("OK")).alias("status"))


# Whole workflows.


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def combine_datasets(spark, sf):
    """Two trees to quads by their own layouts, one dataset, and a third layout over both."""
    ids = {"intro": [], "value": {"layout": {"type": "id"}, "input": "_:self"}}
    left, lref = compiled(record(id=ids, s_name=field("s_name"), nation={"value": {"type": "id"}, "property": BASE + "inNation"}))
    right, rref = compiled(record(id=ids, n_name=field("n_name")))
    suppliers = table(spark, sf, "supplier").select(subject("supplier", "s_suppkey").alias("id"), "s_name", subject("nation", "s_nationkey").alias("nation"))
    nations = table(spark, sf, "nation").select(subject("nation", "n_nationkey").alias("id"), "n_name")
    quads = dehydrate(left, lref, suppliers, ["id"]).quads.unionByName(dehydrate(right, rref, nations, ["id"]).quads).dropDuplicates()
    both, ref = compiled(record(s_name=field("s_name"), nation={"value": record(n_name=field("n_name", required=True)), "property": BASE + "inNation"}))
    out = hydrate(both, ref, quads, roots(table(spark, sf, "supplier"), "supplier", "s_suppkey"))
    return out.select(key_of().alias("s_suppkey"), "value.s_name", F.col("value.nation.n_name").alias("n_name"))


PRESETS = BASE + "prelude#"


@query("SELECT p_partkey, p_size::SMALLINT AS u8, (p_size * 100)::INTEGER AS u16, p_partkey AS u32, p_size::TINYINT AS i8, p_name AS string FROM part")
def preset_types(spark, sf):
    part = table(spark, sf, "part")
    kinds = {"u8": "unsignedByte", "u16": "unsignedShort", "u32": "unsignedInt", "i8": "byte", "string": "string"}
    values = {"u8": F.col("p_size"), "u16": F.col("p_size") * 100, "u32": F.col("p_partkey"), "i8": F.col("p_size"), "string": F.col("p_name")}
    s = F.concat(F.lit("<"), subject("part", "p_partkey"), F.lit(">"))
    each = F.array(*(F.struct(s.alias("s"), F.lit(term(k)).alias("p"), F.concat(F.lit('"'), v.cast("string"), F.lit('"' if k == "string" else f'"^^<{XSD}{kinds[k]}>')).alias("o"), F.lit(None).cast("string").alias("g")) for k, v in values.items()))
    layouts, ref = compiled(record(**{k: {"value": PRESETS + k, "property": BASE + k} for k in kinds}))
    out = hydrate(layouts, ref, part.select(F.inline(each)), roots(part, "part", "p_partkey"))
    return out.select(key_of().alias("p_partkey"), "value.*")


@layout(prefixes={"ex": BASE}, id="ex:PartShape")
class PartShape:
    p_brand: str = prop("ex:p_brand")
    p_size: int | None = prop("ex:p_size", datatype=XSD + "int")
    url: Id | None = prop("ex:url")
    level: U8 | None = prop("ex:level")


@query("SELECT p_partkey, p_brand, p_size, NULL::VARCHAR AS url FROM part")
def class_layout(spark, sf):
    """A layout from an annotated class."""
    layouts, ref = compiled(PartShape.layout)
    out = hydrate(layouts, ref, part_quads(spark, sf, "p_brand", "p_size"), roots(table(spark, sf, "part"), "part", "p_partkey"))
    return out.select(key_of().alias("p_partkey"), "value.p_brand", "value.p_size", "value.url")


@query("SELECT 'level' AS name, 'smallint' AS type UNION ALL SELECT 'p_brand', 'string' UNION ALL SELECT 'p_size', 'int' UNION ALL SELECT 'url', 'string'")
def schema_of_layout(spark, sf):
    layouts, ref = compiled(PartShape.layout)
    assert to_ddl(layouts, ref)
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in to_spark_type(layouts, ref)], "name string, type string")


@query("""WITH RECURSIVE t AS (SELECT n_nationkey AS k, n_name, '{"name":"' || n_name || '"}' AS json FROM nation WHERE n_nationkey = 0
UNION ALL SELECT n.n_nationkey, n.n_name, '{"name":"' || n.n_name || '","parent":' || t.json || '}' FROM nation n JOIN t ON n.n_nationkey > 0 AND n.n_nationkey // 2 = t.k)
SELECT k::BIGINT AS k, json FROM t""")
def recursive_layout(spark, sf):
    """A layout that calls itself: nations as a binary tree, each with its line of parents."""
    nation = table(spark, sf, "nation").withColumn("up", F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 2)))
    quads = lift(nation.withColumnRenamed("n_name", "name"), "nation", ["n_nationkey"], ["name"]).unionByName(link(nation.where("up IS NOT NULL"), "nation", ["n_nationkey"], "parent", "nation", ["up"]))
    layouts, ref = compiled({"id": BASE + "Node"} | record(name=field("name"), parent={"value": BASE + "Node", "property": BASE + "parent"}))
    return hydrate(layouts, ref, quads, roots(nation, "nation", "n_nationkey")).select(key_of().alias("k"), "json")


@query(_NATION_QUADS)
def streaming_dehydrate(spark, sf):
    """The same rows as a stream, available files only."""
    nation = table(spark, sf, "nation")
    rows = spark.readStream.schema(nation.schema).parquet(f"{sf}/nation.parque[t]")
    columns = ["n_nationkey", "n_name", "n_regionkey"]
    layouts, ref = compiled(table_layout(nation.schema, columns))
    quads = dehydrate_stream(layouts, ref, rows.select(subject("nation", "n_nationkey").alias("id"), *columns), ["id"])
    path = shared_path(spark, "stream")
    quads.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("s", "p", "o")


def nested_quads(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    quads = lift(nation, "nation", ["n_nationkey"], ["n_name"]).unionByName(link(nation, "nation", ["n_nationkey"], "inRegion", "region", ["n_regionkey"]))
    return quads, lift(region, "region", ["r_regionkey"], ["r_name"])


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def streaming_hydrate(spark, sf):
    """Nations arrive first, their regions in a later batch: a nation's tree is made again when
    the region that it shows comes in, and the last tree of each is right."""
    first, later = nested_quads(spark, sf)
    path = shared_path(spark, "quad-stream")
    for quads in (first, later):
        quads.write.mode("append").parquet(f"{path}/in")
    layouts, ref = compiled(record(n_name=field("n_name", required=True), region={"value": record(r_name=field("r_name")), "property": BASE + "inRegion"}))
    sink = lambda trees, n: trees.where("status IS NULL").select("in0", "value.n_name", F.col("value.region.r_name").alias("r_name"), F.lit(n).alias("n")).write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    source = spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    running = hydrate_stream(layouts, ref, source, f"{path}/quads", sink, f"{path}/state")
    running.processAllAvailable()
    running.stop()
    trees_ = spark.read.parquet(f"{path}/out")
    last = trees_.groupBy("in0").agg(F.max_by(F.struct("n_name", "r_name"), "n").alias("t"))
    return last.select(key_of().alias("n_nationkey"), "t.n_name", "t.r_name")


# Numbers and statuses.


_NINES = "repeat('9', CAST(o_orderkey % 45 AS INTEGER) + 1)"


@query(f"SELECT o_orderkey, {_NINES} || '.' || repeat('0', CAST(o_custkey % 25 AS INTEGER)) || '1' AS lexical, CASE WHEN o_orderkey % 45 + 1 <= 20 AND o_custkey % 25 + 1 <= 18 THEN 'OK' ELSE 'NUMBER_RANGE' END AS status FROM orders")
def number_precision(spark, sf):
    """Numerals of any size: exact as text, and as decimals with a status where a column of
    the datatype's type can't hold them."""
    orders = table(spark, sf, "orders")
    shown = F.concat(F.repeat(F.lit("9"), (F.col("o_orderkey") % 45 + 1).cast("int")), F.lit("."), F.repeat(F.lit("0"), (F.col("o_custkey") % 25).cast("int")), F.lit("1"))
    quads = orders.select(F.concat(F.lit("<"), subject("order", "o_orderkey"), F.lit(">")).alias("s"), F.lit(term("x")).alias("p"), F.concat(F.lit('"'), shown, F.lit(f'"^^<{XSD}decimal>')).alias("o"), F.lit(None).cast("string").alias("g"))
    layouts, ref = compiled(record(x=field("x", *DEC)))
    at = roots(orders, "order", "o_orderkey")
    exact = hydrate(layouts, ref, quads, at, numbers="text").select("in0", F.col("value.x").alias("lexical"))
    held = hydrate(layouts, ref, quads, at).select("in0", F.coalesce("status", F.lit("OK")).alias("status"))
    return exact.join(held, "in0").select(key_of().alias("o_orderkey"), "lexical", "status")


@query(f"SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'OK' ELSE 'MISSING_REQUIRED' END AS status, CASE WHEN c_acctbal > 0 THEN '' ELSE '/who/<{BASE}customer/' || c_custkey || '>/balance' END AS place FROM customer")
def status_places(spark, sf):
    """Where in a nested tree a value failed: field, item of a set, field."""
    customer = table(spark, sf, "customer")
    quads = rich_quads(spark, sf).unionByName(link(customer, "visit", ["c_custkey"], "by", "customer", ["c_custkey"]))
    one = record(c_name=field("c_name"), balance=field("balance", *DEC, required=True))
    everyone = {"type": "set", "item": {"value": one, "property": BASE + "by"}}
    layouts, ref = compiled(record(who={"intro": [], "value": {"layout": everyone, "input": "_:self"}}))
    out = hydrate(layouts, ref, quads, roots(customer, "visit", "c_custkey"))
    return out.select(key_of().alias("c_custkey"), F.coalesce("status", F.lit("OK")).alias("status"), F.coalesce("status_place", F.lit("")).alias("place"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey = 2 THEN 'INCOMPATIBLE_LAYOUT' ELSE 'OK' END AS status, CASE WHEN n_regionkey = 2 THEN '/names/1' ELSE '' END AS place FROM nation")
def write_status_places(spark, sf):
    """The place of a value that can't be written: field, place in the list."""
    name, other = F.concat(F.lit('"'), F.col("n_name"), F.lit('"')), F.when(F.col("n_regionkey") == 2, F.lit("7")).otherwise(F.lit('"x"'))
    text = F.concat(F.lit('{"names":['), name, F.lit(","), other, F.lit("]}"))
    rows = table(spark, sf, "nation").select("n_nationkey", F.parse_json(text).alias("v"))
    names = {"intro": [], "value": {"layout": {"type": "set", "item": {"value": {"type": "string"}, "property": BASE + "name"}}, "input": "_:self"}}
    layouts, ref = compiled(record(names=names))
    out = dehydrate(layouts, ref, rows, ["n_nationkey"], value="v").inputs
    return out.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.coalesce("status", F.lit("OK")).alias("status"), F.coalesce("status_place", F.lit("")).alias("place"))


# Formats, options and registries.


@query("SELECT 'a1666e5f6e616d65d82a' || printf('%02x', 96 + length(n_name)) || lower(hex(n_name)) AS cbor, n_nationkey::BIGINT AS n_nationkey FROM nation")
def cbor_tagged(spark, sf):
    """The bytes of a tagged text in a map."""
    name = field("n_name")
    name["value"] = name["value"] | {"extra": {"https://example.org/cbor#tag": 42}}
    layouts, ref = compiled(record(n_name=name))
    out = hydrate(layouts, ref, nation_quads(spark, sf), roots(table(spark, sf, "nation"), "nation", "n_nationkey"))
    return cbor.to_cbor(out, layouts, ref).select(F.lower(F.hex("cbor")).alias("cbor"), key_of("key").alias("n_nationkey"))


@query("""SELECT 'a1616b' || CASE WHEN k < 24 THEN printf('%02x', k) WHEN k < 256 THEN '18' || printf('%02x', k) ELSE '19' || printf('%04x', k) END AS cbor, count(*) AS n
FROM (SELECT json_extract(props, '$.k')::INTEGER AS k FROM events) GROUP BY 1""")
def cbor_untyped(spark, sf):
    """JSON documents as CBOR without a layout."""
    rows = table(spark, sf, "events").select(F.to_json(F.parse_json("props")).alias("json"))
    return cbor.json_to_cbor(rows).select(F.lower(F.hex("cbor")).alias("cbor")).groupBy("cbor").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT '{' || chr(10) || '  "n_name": "' || n_name || '",' || chr(10) || '  "n_nationkey": ' || n_nationkey || chr(10) || '}' AS json FROM nation""")
def json_pretty(spark, sf):
    layouts, ref = compiled(record(n_nationkey=field("n_nationkey", *INT), n_name=field("n_name")))
    return trees.pretty(hydrate(layouts, ref, nation_quads(spark, sf), roots(table(spark, sf, "nation"), "nation", "n_nationkey"))).select(F.col("value").alias("json"))


@query(f"SELECT s || ' ' || p || ' ' || o || ' .' AS line, row_number() OVER (ORDER BY s, p, o) AS place FROM ({_NATION_QUADS})")
def nquads_ordered(spark, sf):
    """The ordered sink: its files in the order of their names are one sorted sequence."""
    path = shared_path(spark, "nquads-ordered")
    nquads.write_nquads(nation_quads(spark, sf), path, ordered=True)
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    place = F.row_number().over(Window.orderBy("file", "id"))
    return lines.select("line", place.cast("bigint").alias("place"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 1::BIGINT AS matches FROM nation")
def empty_pattern(spark, sf):
    """A pattern without quads matches each frame once, with no new variable."""
    frames = roots(table(spark, sf, "nation"), "nation", "n_nationkey").select(F.lit("").alias(GRAPH), F.col("in0").alias("_0"))
    return match(placed(spark, sf), frames, ()).groupBy(key_of("_0").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("matches"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'OK' ELSE 'INCOMPATIBLE_LAYOUT' END AS status FROM part")
def tree_constants(spark, sf):
    """A constant that is a tree equals values of the same JSON."""
    shown = F.when(F.col("p_size") % 2 == 0, F.lit('{"b": [1, null],  "a": "x"}')).otherwise(F.lit('{"a":"x","b":[null,1]}'))
    rows = table(spark, sf, "part").select("p_partkey", F.parse_json(shown).alias("v"))
    layouts, ref = compiled({"type": "unit", "const": {"a": "x", "b": [1, None]}})
    return dehydrate(layouts, ref, rows, ["p_partkey"], value="v").inputs.select("p_partkey", F.coalesce("status", F.lit("OK")).alias("status"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def registry_union(spark, sf):
    """A layout of one registry calls one of another."""
    near, far = Layouts(), Layouts()
    far.add({"id": BASE + "Region"} | record(r_name=field("r_name")))
    ref = near.add(record(n_name=field("n_name"), region={"value": BASE + "Region", "property": BASE + "inRegion"}))
    out = hydrate(near.chain(far).chain(prelude()), ref, place_quads(spark, sf), roots(table(spark, sf, "nation"), "nation", "n_nationkey"))
    return out.select(key_of().alias("n_nationkey"), "value.n_name", F.col("value.region.r_name").alias("r_name"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name || '/' || n_regionkey AS names FROM nation")
def layout_files(spark, sf):
    """Layouts loaded from files that refer to each other, and the order of their references."""
    folder = shared_path(spark, "layouts")
    documents = {"a.json": {"id": BASE + "File"} | {"type": "tuple", "items": [{"value": BASE + "Name", "property": BASE + "n_name"}, {"value": {"type": "number", "datatype": XSD + "int"}, "property": BASE + "n_regionkey"}]}, "b.json": {"id": BASE + "Name", "type": "string"}}
    for name, document in documents.items():
        fs, file = file_system(spark, f"{folder}/{name}")
        stream = fs.create(file)
        stream.write(bytearray(json.dumps(document).encode()))
        stream.close()
    texts = {r.file.rsplit("/", 1)[1]: r.value for r in spark.read.option("wholetext", True).text(folder).select(F.input_file_name().alias("file"), "value").collect()}
    layouts = Layouts()
    refs = [layouts.add(texts[name]) for name in sorted(texts)]
    assert layouts.dependencies(refs[0])[0] == refs[1]
    out = hydrate(layouts.chain(prelude()), refs[0], nation_quads(spark, sf), roots(table(spark, sf, "nation"), "nation", "n_nationkey"))
    return out.select(key_of().alias("n_nationkey"), F.concat_ws("/", "value._0", F.col("value._1").cast("string")).alias("names"))


@query("SELECT 25::BIGINT AS nodes, 0::BIGINT AS shared, 25::BIGINT AS again")
def skolem_prefixes(spark, sf):
    """Blank nodes are named by prefix, key and place: as often as they are made."""
    rows = table(spark, sf, "nation").select("n_nationkey", F.struct("n_name").alias("v"))
    layouts, ref = compiled(record(n_name=field("n_name")))
    one, two, again = (dehydrate(layouts, ref, rows, ["n_nationkey"], value="v", skolem_prefix=x).quads.select("s") for x in ("a", "b", "a"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(one, "nodes").crossJoin(count(one.join(two, "s"), "shared")).crossJoin(count(one.join(again, "s"), "again"))


def _case(run: Callable[[], Any]) -> str:
    try:
        return str(run())
    except ValueError as e:
        return f"error: {str(e).split(': ')[-1]}" if not str(e).isupper() else str(e)


def cases(spark: SparkSession, rows: list[tuple[str, Callable[[], Any]]]) -> DataFrame:
    """(name, result) of what the driver works out when a layout is compiled."""
    return spark.createDataFrame([(name, _case(run)) for name, run in rows], "name string, result string")


def values_sql(rows: list[tuple[str, str]]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows) + ") AS t(name, result)"


@query(values_sql([("fraction 3/8", "0.375"), ("fraction -7/20", "-0.35"), ("fraction 10/4", "2.5"), ("fraction 5/12", "None"), ("fraction 0/3", "0"), ("fraction 1/1024", "0.0009765625")]))
def decimal_expansions(spark, sf):
    from shapeloom.functions.values import decimal_digits

    return cases(spark, [(f"fraction {n}/{d}", lambda n=n, d=d: decimal_digits(n, d)) for n, d in ((3, 8), (-7, 20), (10, 4), (5, 12), (0, 3), (1, 1024))])


@query(values_sql([("t:x", "http://terms.test/x"), ("urn:isbn:1", "urn:isbn:1"), ("leaf", "http://host.test/dir/leaf"), ("../up", "http://host.test/up"), ("#part", "http://host.test/dir/file#part"), ("//other.test/y", "http://other.test/y")]))
def iri_resolution(spark, sf):
    return cases(spark, [(x, lambda x=x: resolve(x, "http://host.test/dir/file", {"t": "http://terms.test/"})) for x in ("t:x", "urn:isbn:1", "leaf", "../up", "#part", "//other.test/y")])


@query(values_sql([("_:b1", "_:b1"), ("http://host.test/a", "<http://host.test/a>"), ("<http://host.test/a>", "<http://host.test/a>"), ('"text"@en', '"text"@en'), ("not an iri", "error: 'not an iri'")]))
def written_terms(spark, sf):
    return cases(spark, [(x, lambda x=x: parse_term(x)) for x in ("_:b1", "http://host.test/a", "<http://host.test/a>", '"text"@en', "not an iri")])


@query(values_sql([("part size", "PartSize"), ("n-nation_key", "NNationKey"), ("9 lives", "_9Lives"), ("already", "Already")]))
def type_names(spark, sf):
    return cases(spark, [(x, lambda x=x: type_name(x)) for x in ("part size", "n-nation_key", "9 lives", "already")])


@query(values_sql([("[5-70-2]", "[0-25-7]"), ("q|[r]", "q|r"), (r"\t{", r"\t{"), ("(m|)n", "(m|)n"), ("k(st)", "kst"), ("[^-^]", r"[^\-\^]")]))
def regexp_forms(spark, sf):
    """Expressions simplified and shown in their own dialect."""
    return cases(spark, [(x, lambda x=x: regexp.show(regexp.parse(x))) for x in ("[5-70-2]", "q|[r]", r"\t{", "(m|)n", "k(st)", "[^-^]")])


def _refusals() -> list[tuple[str, Callable[[], Any]]]:
    def add(document: Any) -> Callable[[], Any]:
        return lambda: Layouts().add(document)

    def called(n: int) -> Callable[[], Any]:
        layouts, ref = compiled({"id": BASE + "One", "type": "string"})
        return lambda: layouts.call(Call(ref, tuple(range(n))))

    return [
        ("union", add({"type": "union"})),
        ("intersection", add({"type": "intersection"})),
        ("variable name", add({"type": "string", "input": "9a"})),
        ("no input", called(0)),
        ("two inputs", called(2)),
        ("unknown layout", lambda: Layouts()["<http://host.test/none>"]),
    ]


@query(values_sql([(x, "refused") for x in ("union", "intersection", "variable name", "no input", "two inputs", "unknown layout")]))
def refused_layouts(spark, sf):
    """Layouts and calls that are refused before any data is read."""

    def outcome(run: Callable[[], Any]) -> str:
        try:
            run()
        except ValueError:
            return "refused"
        return "accepted"

    return cases(spark, [(name, lambda run=run: outcome(run)) for name, run in _refusals()])


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, 'shown as a heading' AS hint FROM nation")
def extra_properties(spark, sf):
    """What a layout says beside its meaning is kept with it and changes no result."""
    heading = "https://example.org/hint"
    layouts, ref = compiled({"extra": {heading: "shown as a heading"}} | record(n_name=field("n_name")))
    out = hydrate(layouts, ref, nation_quads(spark, sf), roots(table(spark, sf, "nation"), "nation", "n_nationkey"))
    return out.select(key_of().alias("n_nationkey"), "value.n_name", F.lit(str(dict(layouts[ref].extra)[f"<{heading}>"] if f"<{heading}>" in dict(layouts[ref].extra) else dict(layouts[ref].extra)[heading])).alias("hint"))


@layout("set", prefixes={"ex": BASE}, id="ex:Segments")
class Segments:
    segment: str = prop("ex:c_mktsegment")


@layout("unit", prefixes={"ex": BASE}, const="here", dataset=[["_:self", "ex:inRegion", "ex:region/1"]])
class InRegionOne: ...


@query("SELECT c_custkey, c_mktsegment AS segments FROM customer")
def class_of_a_set(spark, sf):
    """A class that is a set of its own."""
    layouts, ref = compiled(Segments.layout)
    customer = table(spark, sf, "customer")
    out = hydrate(layouts, ref, lift(customer, "customer", ["c_custkey"], ["c_mktsegment"]), roots(customer, "customer", "c_custkey"))
    return out.select(key_of().alias("c_custkey"), F.array_join("value", "|").alias("segments"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, 'here' AS value FROM nation WHERE n_regionkey = 1")
def class_of_a_unit(spark, sf):
    layouts, ref = compiled(InRegionOne.layout)
    out = hydrate(layouts, ref, place_quads(spark, sf), roots(table(spark, sf, "nation"), "nation", "n_nationkey"), mode="dropmalformed")
    return out.select(key_of().alias("n_nationkey"), "value")
