"""The registered queries on the smallest driver tables, against their SQL."""

from __future__ import annotations

import os

import pytest

from factgraph.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    out = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in out.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[names.index(c)] for c in columns]) for r in out.fetchall())


def test_quality_rules_sql_on_every_white_space(spark, tmp_path):
    import duckdb

    words = [f"w{k}" for k in range(30)]
    texts = [sep.join(words) for sep in " \t\n\x0b\x0c\r"]
    texts += ["\r\n".join(words * 2), "\x0b \x0c".join(["a b c d e f g h"] * 5), "a\u00a0b\u2003c\x1cd " * 9, "\r", "", None, "#*$%&|<>\r\x0c#"]
    docs = spark.createDataFrame([(k, "h" if k % 3 else None, text) for k, text in enumerate(texts)], "doc_id long, source string, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    out = con.execute(queries.oracle_sql()["op3_quality_rules"])
    names = [d[0] for d in out.description]
    df = queries.op3_quality_rules(spark, str(tmp_path))
    columns = sorted(df.columns)
    assert columns == sorted(names)
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[names.index(c)] for c in columns]) for r in out.fetchall())
