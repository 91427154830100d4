"""Answers parsed once into a variant: what is read from it is what the paths over the text give."""

from __future__ import annotations

from pyspark.sql import functions as F

from factgraph.functions import jsonio as J

BODIES = [
    '{"choices":[{"message":{"content":"a \\"b\\""}}]}',
    '{"candidates":[{"content":{"parts":[{"text":"x"}]}}]}',
    '{"response":"r","choices":[]}',
    '{"response":null}',
    '{"response":{"k":[1,"2"]}}',
    '{"response":7}',
    '{"eventType":"view","version":"3.0","timestamp":"2024-05-01T10:00:00"}',
    '{"eventType":"view","version":3.9}',
    '{"eventType":"other","version":"x","timestamp":5}',
    "[]",
    "7",
    "no JSON",
    "",
    None,
]
NOW = "2024-01-01 00:00:00"


def test_variant_gives_what_paths_give(spark):
    rows = spark.createDataFrame(list(enumerate(BODIES)), "id int, body string")
    now = F.lit(NOW).cast("timestamp")
    got = J.parsed(rows, "body").select("id", J.unwrap_parsed("json").alias("answer"), J.tolerant_event_parsed("json", ["view"], now).alias("event"))
    want = rows.select("id", J.unwrap(F.col("body")).alias("answer"), J.tolerant_event(F.col("body"), ["view"], now).alias("event"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_own_path_first_and_kinds(spark):
    rows = J.parsed(spark.createDataFrame([('{"out":{"text":"mine"},"response":"r","n":5}',)], "body string"), "body")
    row = rows.select(J.unwrap_parsed("json", "$.out.text").alias("a"), J.unwrap_parsed("json", "$.none").alias("b"), J.at("json", "$.n", "int").alias("n"), J.at("json", "$.response", "int").alias("bad")).first()
    assert tuple(row) == ("mine", "r", 5, None)


def test_object_with_a_key_twice_is_null(spark):
    assert J.parsed(spark.createDataFrame([('{"response":"a","response":"b"}',)], "body string"), "body").first()["json"] is None


def test_parsed_once(spark):
    rows = spark.createDataFrame(list(enumerate(BODIES)), "id int, body string")
    out = J.parsed(rows, "body").select(J.unwrap_parsed("json", "$.own"), J.tolerant_event_parsed("json", ["view"], F.current_timestamp()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1, plan
