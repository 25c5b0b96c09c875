"""Registered functions on odd values."""

import math

from weir.functions import binding, registered


def test_geometric_mean_of_zeros_and_nulls(spark):
    registered.register(spark)
    rows = [("a", 4.0), ("a", 9.0), ("a", None), ("b", 0.0), ("b", 5.0), ("c", None), ("d", -1.0), ("d", 2.0), ("e", float("nan")), ("e", 1.0)]
    got = binding.run_sql(spark, "SELECT k, geometric_mean(v) AS g FROM t GROUP BY k", None, t=spark.createDataFrame(rows, "k string, v double"))
    g = {r.k: r.g for r in got.collect()}
    assert abs(g["a"] - 6) < 1e-12 and g["b"] == 0 and g["c"] is None and math.isnan(g["d"]) and math.isnan(g["e"])
