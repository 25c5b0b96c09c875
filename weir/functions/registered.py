"""Functions by name for SQL: scalar ones as SQL expressions, which stay in the JVM; an aggregate and a table function in Python, by Arrow."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Scalar functions: name, arguments, result, expression.
SCALARS = [
    ("my_upper", "s STRING", "STRING", "upper(s)"),
    ("jvm_trim", "s STRING", "STRING", r"regexp_replace(s, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '')"),
    ("safe_ratio", "a DOUBLE, b DOUBLE, empty DOUBLE", "DOUBLE", "if(b > 0, a / b, empty)"),
]


class SplitWords:
    """Rows (pos, word) of a text's space-separated words."""

    def eval(self, text: str):
        for k, w in enumerate((text or "").split()):
            yield k, w


def register(spark: SparkSession) -> None:
    for name, arguments, result, expression in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {expression}")

    @F.arrow_udf("double")
    def geometric_mean(v: pa.Array) -> float:
        """0 if a value is 0, NaN if one is negative, null without values."""
        import numpy as np

        v = v.drop_null().to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            return float(np.exp(np.log(v).mean())) if len(v) else None

    spark.udf.register("geometric_mean", geometric_mean)
    spark.udtf.register("split_words", F.udtf(SplitWords, returnType="pos int, word string"))


def add(spark: SparkSession, name: str, arguments: str, result: str, expression: str) -> None:
    """A scalar function of one's own."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {expression}")
