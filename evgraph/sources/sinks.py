"""Keyed writes as appends and latest-state views (SNK).

Plain Parquet has no row update.  Stores are append-only folders; the current
state is a view over the newest row per key.  Ids come from content, so a job
that runs twice appends nothing new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.operators.ordered import latest


def _written(d: DataFrame, keys: list[str], path: str, mode: str, run: str | None, kind: str) -> None:
    """Write by partition columns; a named run replaces what it wrote before, and nothing else.

    The run is the outermost folder and is overwritten as a whole, so a run that is repeated after a
    failure, with more or fewer partitions than before, leaves exactly its own rows.
    """
    d = d.hint("rebalance", *keys)
    if run is not None:
        path, mode = f"{path}/run={run}", "overwrite"
    d.write.mode(mode).partitionBy(*keys).format(kind).save(path)


def write_payloads(payloads: DataFrame, path: str, mode: str = "append", run: str | None = None) -> None:
    """SNK-01: all payloads, accepted or not, by source and content month.

    A source that holds a large share of the rows is spread over several tasks by
    AQE; rows of one partition folder are not forced into one task.
    """
    d = payloads.withColumn("month", F.date_format("content_timestamp", "yyyy-MM"))
    _written(d, ["source_id", "month"], path, mode, run, "parquet")


def archive_payloads(payloads: DataFrame, path: str, mode: str = "append", run: str | None = None) -> None:
    """SNK-02: accepted payloads as JSON by source and content month."""
    d = payloads.filter(~F.col("rejected")).withColumn("month", F.date_format("content_timestamp", "yyyy-MM"))
    _written(d, ["source_id", "month"], path, mode, run, "json")


def archive_layout(payloads: DataFrame) -> DataFrame:
    """Rows per archive folder, without writing."""
    return payloads.filter(~F.col("rejected")).groupBy(
        "source_id", F.date_format("content_timestamp", "yyyy-MM").alias("month")
    ).agg(F.count(F.lit(1)).alias("n_payloads"))


def only_new(rows: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """SNK-03: rows whose key is not stored yet, one per key."""
    new = rows.dropDuplicates(keys)
    return new if stored is None else new.join(stored.select(*keys), keys, "left_anti")


def append_events(events: DataFrame, path: str, run: str | None = None) -> None:
    """SNK-06: mutation events by content month."""
    d = events.withColumn("month", F.date_format("batch_time", "yyyy-MM"))
    _written(d, ["month"], path, "append", run, "parquet")


def signal_states(signals: DataFrame, states: DataFrame) -> DataFrame:
    """SNK-04/05: signals with their newest anchored flag and cluster.

    ``states`` holds signal_id, seq, anchored, cluster_id and cluster_strength;
    a null field leaves the value as it was.
    """
    set_ = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    now = states.groupBy("signal_id").agg(
        *[set_(c).alias(f"new_{c}") for c in ("anchored", "cluster_id", "cluster_strength")]
    )
    d = signals.join(now, "signal_id", "left")
    for c in ("anchored", "cluster_id", "cluster_strength"):
        old = F.col(c) if c in signals.columns else F.lit(None)
        d = d.withColumn(c, F.coalesce(f"new_{c}", old)).drop(f"new_{c}")
    return d


def mark_anchored(signals: DataFrame, seq: int) -> DataFrame:
    """SNK-04: state rows that mark the signals anchored."""
    return signals.select(
        "signal_id", F.lit(seq).alias("seq"), F.lit(True).alias("anchored"),
        F.lit(None).cast("string").alias("cluster_id"),
        F.lit(None).cast("double").alias("cluster_strength"),
    )


def assign_cluster(signals: DataFrame, seq: int, strength: float = 1.0) -> DataFrame:
    """SNK-05: state rows that put the signals into their ``cluster_id``."""
    return signals.select(
        "signal_id", F.lit(seq).alias("seq"), F.lit(None).cast("boolean").alias("anchored"),
        F.col("cluster_id").cast("string").alias("cluster_id"),
        F.lit(strength).alias("cluster_strength"),
    )


def current(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest-state view of an append-only store."""
    return latest(rows, keys, order)


def prune_sessions(sessions: DataFrame, messages: DataFrame, *, now, hours: int = 48):
    """SNK-15: sessions still active and the messages that go with them."""
    kept = sessions.filter(F.col("last_active") >= F.lit(now) - F.make_dt_interval(hours=F.lit(hours)))
    return kept, messages.join(kept.select("session_id"), "session_id", "left_semi")
