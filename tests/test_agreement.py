from petrigrid.operators import metrics as E


def test_methods_are_not_shuffled(spark):
    """Methods are few: a shuffle on them would give a third of all suggestions to one task."""
    rows = [(i, j, 10.0 * j + d, 5.0, m) for i in (1, 2) for j in range(6) for m, d in (("a", 0.0), ("b", 1.0), ("c", 40.0)) if (i + j) % 4 or m == "a"]
    s = spark.createDataFrame(rows, "image_id int, suggestion_id int, x double, y double, method string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables too large to broadcast by themselves
        out = E.agreement(s, ["image_id"], 12.0)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [method#" not in plan and "SortMergeJoin [method_b#" not in plan
    assert len(got) == 6 and all(0.0 <= r[3] <= 1.0 for r in got)
