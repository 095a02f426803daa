"""First candidates by line and part, with numbers of any size."""

import duckdb

import __spark_entry__ as contract


def test_first_match_with_large_part_numbers(spark, tmp_path):
    spark.createDataFrame([(1,), (2,), (3,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, 1, 1_900_000), (1, 2, 5), (2, 3, 7), (2, 3, 2_000_007), (2, 4, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = [(1, 1_900_000), (2, 7), (3, None)]
    assert sorted(map(tuple, contract.queries()["first_match_join"](spark, str(tmp_path)).collect())) == want
    assert sorted(con.execute(contract.oracle_sql()["first_match_join"]).fetchall()) == want
