"""Exact row numbers, running totals and previous values without one task per key.

A plain ``Window.partitionBy(key)`` sorts all rows of a key in one task, which a
hot key turns into the slowest task of the job.  The functions here split a key
by a ``bucket`` column that never decreases along the order: a truncated
timestamp, or :func:`range_buckets`, which cuts any order into even pieces.  Rows
are ordered inside a (key, bucket) group only; one summary row per bucket carries
the total or the last value over, and the summaries of a key are few.  Results
equal those of the plain window.

Rows and summaries are both partitioned by one (key, bucket) struct, so the rows
are shuffled once for the window and the join together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evgraph.session import cut_lineage

_G = "__o_group"
#: Rows of one key that a join hands to one task.
TASK_ROWS = 200_000


def range_buckets(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add a bucket number that splits the rows evenly along (keys, order).

    Rows are range partitioned, so a key with very many rows spans many buckets.
    The sampled bounds differ from run to run; writing the numbers makes them
    final before anything is derived from them.  Sampling reads the rows once
    more, so they are written first; hand in narrow ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df).repartitionByRange(n, *keys, *order)
    return cut_lineage(ranged.withColumn(out, F.spark_partition_id()))


def _grouped(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Add the (keys, bucket) struct; inside a struct null keys are equal."""
    return df.withColumn(_G, F.struct(*keys, bucket.alias("__o_bucket")))


def _across(keys: Sequence[str]):
    """Window over the bucket summaries of one key."""
    return W.partitionBy(*[F.col(_G)[k] for k in keys]).orderBy(F.col(_G)["__o_bucket"])


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str = "rn"
) -> DataFrame:
    """``row_number()`` over ``keys`` in ascending ``order``."""
    d = _grouped(df, keys, bucket)
    sizes = d.groupBy(_G).agg(F.count(F.lit(1)).alias("__o_n"))
    before = F.sum("__o_n").over(_across(keys).rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select(_G, F.coalesce(before, F.lit(0)).alias("__o_base"))
    d = d.withColumn("__o_rn", F.row_number().over(W.partitionBy(_G).orderBy(*order)))
    d = d.join(sizes, _G, "left")
    return d.withColumn(out, F.col("__o_rn") + F.col("__o_base")).drop("__o_rn", "__o_base", _G)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """Running sum of ``value`` over ``keys`` in ascending ``order``, the row included."""
    d = _grouped(df, keys, bucket)
    totals = d.groupBy(_G).agg(F.sum(value).alias("__o_t"))
    before = F.sum("__o_t").over(_across(keys).rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(_G, before.alias("__o_base"))
    inner = W.partitionBy(_G).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("__o_run", F.sum(value).over(inner)).join(totals, _G, "left")
    run = F.col("__o_run") + F.coalesce(F.col("__o_base"), F.lit(0))
    return d.withColumn(out, run).drop("__o_run", "__o_base", _G)


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, out: str
) -> DataFrame:
    """``lag(value)`` over ``keys`` in ascending ``order``."""
    d = _grouped(df, keys, bucket)
    last = d.groupBy(_G).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__o_last")
    )
    last = last.select(_G, F.lag("__o_last").over(_across(keys))["v"].alias("__o_prev"))
    inner = W.partitionBy(_G).orderBy(*order)
    d = d.withColumn("__o_first", F.row_number().over(inner) == 1)
    d = d.withColumn("__o_lag", F.lag(value).over(inner)).join(last, _G, "left")
    prev = F.when(F.col("__o_first"), F.col("__o_prev")).otherwise(F.col("__o_lag"))
    return d.withColumn(out, prev).drop("__o_first", "__o_lag", "__o_prev", _G)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key.

    Written so that Catalyst plans a ``WindowGroupLimit`` before the shuffle: each
    task keeps at most ``n`` rows per key, so a hot key sends little.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__o_rank", rank).filter(F.col("__o_rank") <= n).drop("__o_rank")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key, cut in the map tasks first."""
    return top_per_key(df, keys, [F.col(c).desc() for c in order], 1)


def join_summary(
    rows: DataFrame, summary: DataFrame, keys: Sequence[str], n: str, how: str = "left",
    task_rows: int = TASK_ROWS, total: int | None = None,
) -> DataFrame:
    """Join ``rows`` with one ``summary`` row per key, which counts the rows of the key in ``n``.

    AQE does not split such a join, because the summary is partitioned by its own
    grouping.  Here keys with more than ``task_rows`` rows are cut into several: their
    rows get a salt from a hash of the row and the single summary row is repeated per
    salt, so each row still meets exactly one.  At most four keys per shuffle partition
    are treated so, the largest ones; any other key holds a smaller share than a task
    does anyway.  That bound also limits what is broadcast.  ``n`` is dropped.  With a
    known ``total`` of rows, all or those of the largest key, that fits one task no key can
    be hot and the join is plain.
    """
    if total is not None and total <= task_rows:
        return rows.join(summary.drop(n), list(keys), how)
    most = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = summary.filter(F.col(n) > task_rows).orderBy(F.col(n).desc(), *keys).limit(most).select(
        *keys, F.ceil(F.col(n) / task_rows).cast("int").alias("__o_fan")
    )
    hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("__o_fan", F.lit(1))).cast("int")
    left = rows.join(hot, list(keys), "left").withColumn("__o_salt", salt).drop("__o_fan")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__o_fan", F.lit(1)) - 1))
    right = summary.drop(n).join(hot, list(keys), "left").withColumn("__o_salt", every).drop("__o_fan")
    return left.join(right, [*keys, "__o_salt"], how).drop("__o_salt")
