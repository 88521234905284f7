import random

from pyspark.sql import functions as F

from clausemesh.operators import scan, stats


def test_running_values_in_hot_groups(spark):
    rnd = random.Random(1)
    rows = [(None if i % 4 == 0 else i % 3, i, rnd.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, o int, v double").repartition(4)
    specs = {
        "hi": scan.Running("max", F.col("v"), inclusive=False), "lo": scan.Running("min", F.col("v")),
        "n": scan.Running("sum", F.lit(1)), "before": scan.Running("sum", F.lit(1), inclusive=False),
    }
    plain = scan.running(df, ["k"], [F.col("o")], specs).orderBy("o").collect()
    hot = scan.running(df, ["k"], [F.col("o")], specs, hot_rows=40).orderBy("o").collect()
    assert plain == hot


def test_first_rows_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    top = scan.first_rows(df, ["k"], [F.col("id").desc()], 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r.id for r in top.collect()) == [996, 997, 998, 999]


def test_percentiles_by_definition(spark):
    rnd = random.Random(2)
    data = {g: sorted(round(rnd.expovariate(0.01), 1) for _ in range(n)) for g, n in (("a", 1), ("b", 2), ("c", 137), ("d", 1000))}
    data["e"] = [5.0] * 50
    rows = [(g, v) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    near = {r.g: r for r in stats.nearest_percentiles(df, ["g"], "v", [50.0, 99.0]).collect()}
    low = {r.g: r for r in stats.floor_percentiles(df, ["g"], "v").collect()}
    lin = {r.g: r for r in stats.linear_percentiles(df, ["g"], "v", [50.0]).collect()}
    for g, s in data.items():
        n = len(s)
        assert near[g].p99 == s[max(0, min(n - 1, round(0.99 * n) - 1))] and near[g].p50 == s[max(0, min(n - 1, round(0.5 * n) - 1))]
        assert low[g].p95 == s[max(0, int(0.95 * n) - 1)] and low[g].max == s[-1]
        assert lin[g].p50 == s[round(0.5 * (n - 1))]
