"""Numbers of the evaluation report (SNK6)."""

import duckdb
from pyspark.sql import functions as F

from petrigrid.sources.summary_csv import fixed


def test_ratios_are_rounded_as_in_sql(spark):
    """Ties in binary go to even; decimal fives that are not exact go by what they hold."""
    pairs = [(a, b) for b in range(1, 201) for a in range(b + 1)] + [(1, 16), (3, 16), (247, 2000), (1001, 2000)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {(r["a"], r["b"]): r["v"] for r in df.select("a", "b", fixed(F.col("a") / F.col("b"), 3).alias("v")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE p AS SELECT unnest(?) AS a, unnest(?) AS b", [[p[0] for p in pairs], [p[1] for p in pairs]])
    assert got == {(a, b): v for a, b, v in con.execute("SELECT a, b, printf('%.3f', a::DOUBLE / b::DOUBLE) FROM p").fetchall()}
    assert spark.range(1).select(fixed(F.lit(None), 3)).collect()[0][0] is None
