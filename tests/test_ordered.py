import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evgraph.operators import ordered


def rows(spark):
    rng = random.Random(7)
    data = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randrange(40), i,
             rng.choice([None, 1, 2, 3])) for i in range(400)]
    return spark.createDataFrame(data, "k string, t int, id int, v int")


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_numbers_totals_and_lags_equal_plain_windows(spark):
    d = rows(spark)
    bucket = F.floor(F.col("t") / 7)
    w = W.partitionBy("k").orderBy("t", "id")
    cols = ["k", "t", "id", "v", "x"]
    assert same(ordered.number_rows(d, ["k"], ["t", "id"], bucket, "x").select(*cols),
                d.withColumn("x", F.row_number().over(w)))
    d2 = d.withColumn("v", F.coalesce("v", F.lit(0)))
    assert same(ordered.running_total(d2, ["k"], ["t", "id"], bucket, "v", "x").select(*cols),
                d2.withColumn("x", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0))))
    assert same(ordered.previous_value(d, ["k"], ["t", "id"], bucket, "v", "x").select(*cols),
                d.withColumn("x", F.lag("v").over(w)))


def test_top_per_key_plans_a_group_limit_before_the_shuffle(spark):
    d = ordered.top_per_key(rows(spark), ["k"], [F.col("t").desc(), F.col("id")], 3)
    assert "WindowGroupLimit" in d._jdf.queryExecution().executedPlan().toString()
    assert d.groupBy("k").count().agg(F.max("count")).first()[0] == 3


def test_latest(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, s int, v string")
    assert {tuple(r) for r in ordered.latest(d, ["k"], ["s"]).collect()} == {("a", 2, "y"), ("b", 1, "z")}
