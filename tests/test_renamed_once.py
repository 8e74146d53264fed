"""Facts of a file are renamed as they are and merged once, after that."""

import datetime

from noteskein.plans.catalogue import ORACLES, QUERIES
from tests.compare import duck_rows, spark_rows

import duckdb

ROWS = {
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string", [(1, "Ann", 1, "A"), (2, "Bob", 2, "B")]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(1, "One", 1), (2, "Two", 1)]),
    "part": ("p_partkey long, p_brand string", [(1, "Brand"), (2, "Brand")]),
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp, o_orderpriority string",
        [(1, 1, "F", datetime.datetime(2020, 1, 1), "1-URGENT"), (2, 2, "O", datetime.datetime(2020, 1, 2), "5-LOW")],
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string",
        [(1, 1, 1, 1, "R", "F"), (1, 2, 1, 2, "R", "F"), (1, 1, 2, 3, "N", "O"), (2, 1, 1, 1, "N", "O"), (2, 1, 1, 2, "N", "O")],
    ),
}


def test_facts_are_merged_after_the_renaming_only(spark, tmp_path, no_broadcast):
    con = duckdb.connect()
    for name, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = QUERIES["alias_scoped"](spark, str(tmp_path))
    assert spark_rows(found) == duck_rows(con, ORACLES["alias_scoped"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "HashAggregate(keys" in line and "source_file" in line]
