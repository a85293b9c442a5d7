"""Queries whose SQL leaves the choice between equal rows open, on tables that make the choice matter."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from lorestone.plans import catalogue


def test_relates_link_takes_the_first_of_lines_with_one_number(spark, tmp_path):
    def store(name, **columns):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        pq.write_table(pa.table({c: pa.array(v, pa.int32() if c == "l_linenumber" else pa.int64()) for c, v in columns.items()}), tmp_path / name, row_group_size=3)

    # the second file is larger, and Spark reads larger files first; lines without a number or without a supplier never count before others
    store("lineitem.parquet/part-0.parquet", l_orderkey=[1, 1, 2, 4, 5, 7], l_partkey=[1, 1, 1, 2, 2, 2], l_suppkey=[10, 11, 12, None, 13, None], l_linenumber=[2, 1, 5, 9, None, 3])
    store("lineitem.parquet/part-1.parquet", l_orderkey=[1, 2, 2, 4, *range(10, 3000)], l_partkey=[1, 1, 1, 2, *[0] * 2990], l_suppkey=[20, 21, 22, 23, *range(2990)], l_linenumber=[2, 5, 5, 1, *[1] * 2990])
    store("orders.parquet", o_orderkey=list(range(3000)))
    store("part.parquet", p_partkey=[0, 1, 2])
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLE_SQL["relates_link"]).fetchall()
    got = [(r.from_id, r.to_id, r.kind, r.author) for r in catalogue.QUERIES["relates_link"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {("o:1", "p:1", "documents", "user:10"), ("o:2", "p:1", "documents", "user:12"), ("o:4", "p:2", "documents", "user:23"), ("o:5", "p:2", "documents", None)} <= set(got)
