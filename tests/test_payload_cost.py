"""Payload parsers compute each step once and deal their rows over the cluster."""

from types import SimpleNamespace

from conftest import rows
from pyspark.sql import functions as F

from tillbridge.functions.keys import folded_keys, pick
from tillbridge.plans import intake
from tillbridge.sources import events

FORM = "application/x-www-form-urlencoded"


def plan(spark, df):
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 100000)
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


def test_customer_addresses_are_parsed_once(spark):
    body = '{"id":"C1","City!":"kept","addresses":[{"City":"a","city":"b","CITY ":"c"},{"Address 1":" ","address":"x","State":"NY"},7]}'
    df = spark.createDataFrame([(1, body), (2, "[1]"), (3, None)], "k int, payload string")
    out = events.parse_customer_events(df)
    got = {r["k"]: r for r in out.collect()}
    assert [(a["city"], a["address1"], a["province_code"], a["country_code"]) for a in got[1]["addresses"]] == [("b", None, None, "US"), (None, "x", "NY", "US")]
    assert [got[k]["error"] for k in (1, 2, 3)] == [None, "invalid_customer_payload", "invalid_customer_payload"]
    text = plan(spark, out)
    assert text.lower().count("from_json") <= 8  # the body, addresses as a list, one address, metafields
    assert "RoundRobin" in out._jdf.queryExecution().executedPlan().toString()


def test_form_pairs_are_decoded_once(spark):
    df = spark.createDataFrame([(1, "sku=a&tags=x&Tags=y&tags=z&title=t+1", FORM)], "k int, payload string, kind string")
    out = events.parse_product_events(df, content_type="kind")
    assert rows(out, "sku", "title", F.concat_ws(";", "tags"), "error") == [("a", "t 1", "x;z", None)]
    assert plan(spark, out).count("%25") <= 2  # a name and a value


def test_product_fields_are_picked_once(spark):
    body = '{"sku":"","SKU":" s ","Category 1":"c1, c2","category1":"","our sell price":"1.5","PRICE":"2","Department":"d"}'
    out = events.parse_product_events(spark.createDataFrame([(body,)], "payload string"))
    assert rows(out, "sku", "price", F.concat_ws(";", "tags"), "product_type") == [(None, 1.5, "c1;c2;Department:d", "d")]
    assert plan(spark, out).count("element_at") < 600  # each of about 250 names is looked up once in a text of the plan
    assert "RoundRobin" in out._jdf.queryExecution().executedPlan().toString()


def test_form_bodies_are_not_broadcast(spark):
    part = spark.createDataFrame([(k, f"name {k}", f"brand {k}", "type", 5, 1.5) for k in (0, 1, 2, 2)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    out = intake.form_payloads(SimpleNamespace(part=part))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["k"] for r in out.collect()) == [0, 1, 2, 2, 2, 2]


def test_blank_values_are_left_out_once(spark):
    bodies = spark.createDataFrame([('{"a":"","A ":null,"a!":"x","b":"y"}',), (None,)], "body string")
    df = bodies.select(F.from_json("body", "map<string,string>").alias("m"))
    assert rows(df.select(pick(F.col("m"), folded_keys(F.col("m")), "a", "missing").alias("v")), "v") == [(None,), (None,)]
    assert rows(df.select(pick(F.col("m"), folded_keys(F.col("m")), "c", "B").alias("v")), "v") == [("y",), (None,)]
    text = plan(spark, events.parse_product_events(spark.createDataFrame([("{}",)], "payload string")))
    assert text.count("element_at") < 300  # a lookup stood twice for each of its names
