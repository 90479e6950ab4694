"""Calls of sessions whose order their numbers and times leave open, and calls without either."""

from itertools import permutations

import duckdb

from weir import queries
from weir.operators import harvest as V


def test_task_calls_do_not_hang_on_the_order_of_rows(spark):
    rows = [(1, 1, "Task", 100, 3), (1, 1, "Edit", 100, 5), (1, 1, "task", 100, 4), (1, 2, "Read", 160, 1)]
    for some in permutations(rows):
        calls = spark.createDataFrame(some, "session long, seq int, tool string, sec long, entries long").coalesce(1)
        assert [tuple(r) for r in V.task_calls(calls).collect()] == [(1, 2, 7, 60)]


def test_task_calls_without_number_or_time_equal_sql(spark, tmp_path):
    con, path = duckdb.connect(), f"{tmp_path}/lineitem.parquet"
    con.sql("create table t(l_orderkey bigint, l_linenumber int, l_shipdate timestamp)")
    con.sql("insert into t values (1, NULL, '1998-01-01'), (1, 1, '1998-01-02'), (1, 2, '1998-01-05'), (2, 1, NULL), (2, 1, '1998-01-02'), (2, 3, '1998-01-04'), (3, NULL, NULL), (NULL, 1, '1998-01-02'), (NULL, 2, '1998-01-03')")
    con.sql(f"copy (select *, 2::bigint as l_partkey, 3.7::double as l_quantity, 0.05::double as l_discount, 'N' as l_returnflag, 'O' as l_linestatus from t) to '{path}'")
    con.sql(f"create view lineitem as select * from '{path}'")
    want = con.sql(queries.ORACLES["r18_task_calls"])
    got = queries.QUERIES["r18_task_calls"](spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall())) and len(got) == 4
