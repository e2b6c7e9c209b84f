"""Hot keys: a join of rows with one summary row per key spreads over tasks."""

import pytest
from pyspark.sql import functions as F

from evgraph.operators.ordered import join_summary
from evgraph.sources.landed import registry_defaults

ROWS = 30_000


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def rows(spark):
    """Two thirds of all rows on one key."""
    return spark.range(ROWS).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_summary_join_equals_a_plain_join(no_broadcast, how):
    d = rows(no_broadcast)
    s = d.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top")).filter("k <> 2")
    got = join_summary(d, s, ["k"], "n", how, task_rows=500)
    want = d.join(s.drop("n"), "k", how)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_hot_key_is_split(no_broadcast):
    no_broadcast.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    d = rows(no_broadcast)
    s = d.groupBy("k").agg(F.count(F.lit(1)).alias("n"))

    def largest(joined):
        return joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

    plain = largest(d.join(s.select("k", F.col("n").alias("m")), "k"))
    split = largest(join_summary(d, s.withColumn("m", F.col("n")), ["k"], "n", task_rows=200))
    no_broadcast.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert plain > 0.6 * ROWS and split < 0.2 * ROWS


def test_no_environment_value_reaches_the_plan(spark, monkeypatch):
    monkeypatch.setenv("SOME_PRIVATE_NAME", "a-private-value")
    monkeypatch.setenv("BASE_HOST", "h.example")
    raw = spark.createDataFrame(
        [("s", "http://$BASE_HOST/${SOME_PRIVATE_NAME}")], "source_id string, url_base string").selectExpr(
        "source_id", "'n' canonical_name", "url_base", "cast(null as string) tier", "cast(null as string) perspective",
        "cast(null as array<string>) languages", "cast(null as string) access_method", "cast(null as map<string,string>) access_config",
        "cast(null as string) update_cadence", "cast(null as array<string>) domains", "cast(null as double) starting_source_weight",
        "cast(null as boolean) enabled", "cast(null as string) notes")
    plain, some = registry_defaults(raw), registry_defaults(raw, allowed=["BASE_HOST"])
    assert plain.first()["url_base"] == "http://$BASE_HOST/${SOME_PRIVATE_NAME}"
    assert some.first()["url_base"] == "http://h.example/${SOME_PRIVATE_NAME}"
    for d in (plain, some):
        assert "a-private-value" not in d._jdf.queryExecution().toString()
