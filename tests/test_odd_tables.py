"""Queries over given tables with odd cells, against their SQL."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowsight.plans import adapters
from flowsight.plans.streaming_queries import chunks_by_arrival


def against_sql(name, spark, folder, as_set):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{source}'")
    df = entry.queries()[name](spark, folder)
    wanted = con.sql(entry.oracle_sql()[name])
    assert as_set(df.columns, df.collect()) == as_set(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", ["clean_features", "malformed_count", "prepare_features"])
def test_messy_cells_of_null_and_negative_keys_and_broken_quantities(name, spark, sf_dir, as_set, tmp_path):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_orderkey < 200")
    third = F.col("l_linenumber") % 3
    key = F.when(third == 1, -F.col("l_partkey")).when(third == 2, F.col("l_partkey"))
    rows = rows.withColumns({"l_partkey": key, "l_quantity": F.col("l_quantity") + F.col("l_linenumber") / 4})
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    against_sql(name, spark, str(tmp_path), as_set)


def test_late_flows_of_repeated_event_numbers_count_once_each(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id < 100")
    events.union(events).write.parquet(f"{tmp_path}/events.parquet")
    assert adapters.late_flows(spark, str(tmp_path)).count() == 2 * events.count()


def test_chunks_by_arrival_are_bounded_and_follow_each_other(spark, sf_dir):
    flows = adapters.late_flows(spark, sf_dir)
    total = flows.count()
    chunks = chunks_by_arrival(flows, "chunks", rows=total // 10)
    found = [[r[0] for r in c.select("arrival_seq").collect()] for c in chunks]
    assert sorted(sum(found, [])) == sorted(r[0] for r in flows.select("arrival_seq").collect())
    assert all(len(f) <= total // 4 for f in found)
    filled = [f for f in found if f]
    assert all(max(a) < min(b) for a, b in zip(filled, filled[1:]))
    assert sum(c.count() for c in chunks_by_arrival(flows.limit(0), "none", rows=10)) == 0
