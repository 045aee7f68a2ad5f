"""Queries against their SQL on small tables with what the test tables lack: long sheets, blank words, overflow."""

import duckdb
import pandas as pd

import __spark_entry__
from foliospark.operators import lookup


def differences(spark, folder, name, **tables):
    """(only in Spark, only in SQL), rows of one query over the given tables."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.to_parquet(folder / f"{table}.parquet", index=False)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder / table}.parquet'")
    got = __spark_entry__.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    ours = list(map(tuple, got.collect()))
    return sorted(set(ours) - set(want), key=repr), sorted(set(want) - set(ours), key=repr)


def parts(keys):
    n = len(keys)
    return pd.DataFrame({"p_partkey": pd.array(keys, dtype="int64"), "p_name": ["large ring"] * n, "p_brand": [f"Brand#{11 + k % 2}" for k in range(n)], "p_type": ["LARGE"] * n, "p_size": pd.array([k % 50 + 1 for k in range(n)], dtype="int32"), "p_retailprice": [900.0 + k for k in range(n)]})


def test_windows_of_any_length_are_filled_in(spark, tmp_path):
    assert differences(spark, tmp_path, "s_dense", part=parts([0, 1, 5, 63, 64, 700, 60_001, 60_100])) == ([], [])


def test_rules_reach_the_last_row_of_any_sheet(spark, tmp_path):
    assert differences(spark, tmp_path, "s_validated", part=parts([0, 1, 17, 1_048_575, 1_048_576, 1_200_001])) == ([], [])


def test_a_product_beyond_doubles_is_infinite(spark, tmp_path):
    n = 200
    lines = pd.DataFrame({"l_discount": [1e6] * n, "l_linestatus": ["O", ""] * (n // 2), "l_extendedprice": [float(k) for k in range(n)], "l_quantity": [float(k % 50) for k in range(n)], "l_tax": [0.05] * n})
    assert differences(spark, tmp_path, "f_whole_table", lineitem=lines) == ([], [])


def test_blank_words_have_no_say_in_the_median_font(spark, tmp_path):
    texts = ["aaa    bbb    ccc", "", "   ", "a\n\n\nbb ccc", None, "one two  three", " ", "\n"]
    assert differences(spark, tmp_path, "l_median_font", documents=pd.DataFrame({"doc_id": range(len(texts)), "text": texts})) == ([], [])


def test_a_missing_number_is_small(spark, tmp_path):
    rows = pd.DataFrame({"c_custkey": [1, 2, 3], "c_nationkey": pd.array([3, None, 20], dtype="Int32"), "c_acctbal": [1.5, -2.5, None]})
    assert differences(spark, tmp_path, "f_number_format", customer=rows) == ([], [])


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_a_small_table_is_looked_up_without_dealing_the_rows(spark, monkeypatch):
    left = spark.range(3000).selectExpr("id", "cast(id % 700 as double) as x")
    table = spark.range(0, 600, 3).selectExpr("cast(id as double) as k", "id as v")
    want = {(i, (i % 700) // 3 * 3 if i % 700 < 600 else 597) for i in range(3000)}
    monkeypatch.setattr(lookup, "LOOKUPS", 100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = lookup.vlookup_approximate(left, "x", table, "k", ["v"])
        assert "SortMergeJoin" not in plan_of(small)
        monkeypatch.setattr(lookup, "FEW_BUCKETS", 0)
        large = lookup.vlookup_approximate(left, "x", table, "k", ["v"], 5)
        for found in (small, large):
            assert {(r.id, r.v) for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cells_that_references_reach_are_not_sent_to_every_task(spark, tmp_path):
    parts([0, 1, 2, 3, 5]).to_parquet(tmp_path / "part.parquet", index=False)
    plan = plan_of(__spark_entry__.queries()["s_references"](spark, str(tmp_path)))
    assert plan.count("SortMergeJoin") >= 2
