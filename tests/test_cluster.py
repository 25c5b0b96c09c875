"""Queries on executors that are processes of their own: what the driver's process holds is not theirs."""

import json
import os
import subprocess
import sys

import duckdb
import pytest

ROOT, SF = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "/root/testdata/sf0.001"
NAMES = ["jdbc_partitioned", "jdbc_round_trip", "jdbc_upsert"]
RUN = """
import json, sys
from pyspark.sql import SparkSession
import __spark_entry__
from weir.sources import embedded
embedded.ROWS = 40
at, sf, *names = sys.argv[1:]
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", f"file://{at}/shared").getOrCreate()
found = {}
for name in names:
    try:
        found[name] = [list(r) for r in __spark_entry__.queries()[name](spark, sf).collect()]
    except Exception as e:
        found[name] = str(e)[:500]
with open(f"{at}/found", "w") as f:
    json.dump(found, f)
spark.stop()
"""


@pytest.fixture(scope="module")
def found(tmp_path_factory):
    at = str(tmp_path_factory.mktemp("cluster"))
    subprocess.run([sys.executable, "-c", RUN, at, SF, *NAMES], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, timeout=300, check=True)
    with open(f"{at}/found") as f:
        return json.load(f)


@pytest.mark.parametrize("name", NAMES)
def test_embedded_database_on_a_cluster(found, name):
    import __spark_entry__

    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    assert isinstance(found[name], list), found[name]
    assert sorted(map(tuple, found[name])) == sorted(want)
