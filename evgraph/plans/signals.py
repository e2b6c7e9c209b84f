"""Reads and roll-ups over the signal store (FLT-06/07, DES-02..05, DES-10/11)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.functions.text import lookup

# Half-lives in days per kind of signal; the kinds are given in words only, the numbers are ours.
HALF_LIFE_DAYS = {
    "spot_price": 3.0, "flow_rate": 21.0, "inventory_level": 90.0, "policy_statement": 365.0,
    "treaty": 1460.0, "infrastructure": 1460.0, "demographic": 1825.0,
}
# Strength of confidence bands in the cluster score; ours.
BAND_WEIGHTS = {"hard_datum": 1.0, "reported_claim": 0.75, "inference": 0.5, "weak_inference": 0.25}


def unanchored(
    signals: DataFrame, *, now: datetime, min_age_hours: int = 1, lens_id: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """FLT-06: signals not yet anchored and old enough, newest content first."""
    d = signals.filter(
        ~F.col("anchored") & (F.col("extracted_at") < F.lit(now - timedelta(hours=min_age_hours)))
    )
    d = d if lens_id is None else d.filter(F.col("lens_id") == lens_id)
    if limit is None:
        return d
    return d.orderBy(F.col("content_timestamp").desc(), "signal_id").limit(limit)


def recent(
    signals: DataFrame, payloads: DataFrame, *, source_id: str | None = None,
    lens_id: str | None = None, limit: int | None = None,
) -> DataFrame:
    """FLT-07, JOI-05: extracted signals, optionally of one lens or source, the newest ``limit``."""
    d = signals if lens_id is None else signals.filter(F.col("lens_id") == lens_id)
    if source_id is not None:
        wanted = payloads.filter(F.col("source_id") == source_id).select("payload_id")
        d = d.join(wanted, "payload_id", "left_semi")
    return d if limit is None else d.orderBy(F.col("extracted_at").desc(), "signal_id").limit(limit)


def with_citation(signals: DataFrame, payloads: DataFrame) -> DataFrame:
    """JOI-03: signals with the source of their payload, null when it is gone."""
    return signals.drop("source_id").join(payloads.select("payload_id", "source_id"), "payload_id", "left")


def cluster_strength(signals: DataFrame, sources: DataFrame) -> DataFrame:
    """DES-03: composite strength per cluster, in [0, 1].

    No formula is specified; ours gives equal parts to signals (full at five),
    perspectives (full at three), mean source weight and mean confidence.
    Weights are summed as decimals, so the result does not depend on row order.
    """
    d = signals.join(
        sources.select("source_id", "perspective", "starting_source_weight"), "source_id", "left"
    )
    exact = lambda c: F.avg(c.cast("decimal(10,4)")).cast("double")
    band = lookup(BAND_WEIGHTS, F.col("confidence_band"), F.lit(0.25))
    d = d.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_signals"), F.countDistinct("perspective").alias("n_perspectives"),
        exact(F.coalesce("starting_source_weight", F.lit(0.5))).alias("mean_weight"),
        exact(band).alias("mean_confidence"),
    )
    score = (
        F.least("n_signals", F.lit(5)) / 5 + F.least("n_perspectives", F.lit(3)) / 3
        + F.col("mean_weight") + F.col("mean_confidence")
    ) / 4
    return d.withColumn("strength", score)


def decayed(signals: DataFrame, *, now: datetime) -> DataFrame:
    """DES-05: remaining weight by the half-life of ``signal_kind``; unknown kinds do not decay."""
    age = (F.unix_micros(F.lit(now)) - F.unix_micros("content_timestamp")) / 86_400_000_000
    life = lookup(HALF_LIFE_DAYS, F.col("signal_kind"))
    left = F.when(life.isNull(), F.lit(1.0)).otherwise(F.pow(F.lit(0.5), age / life))
    return signals.withColumn("remaining_weight", left)


def archive_split(signals: DataFrame, *, now: datetime, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """DES-04: (hot, archived); unanchored signals older than ``days`` leave hot storage."""
    old = ~F.col("anchored") & (F.col("extracted_at") < F.lit(now - timedelta(days=days)))
    return signals.filter(~old), signals.filter(old)


def edge_perspectives(
    events: DataFrame, triggers: DataFrame, signals: DataFrame, sources: DataFrame
) -> DataFrame:
    """DES-11: distinct perspectives among the signals behind each edge."""
    d = (
        events.filter(~F.col("rejected")).select("event_id", F.col("target_edge_id").alias("edge_id"))
        .join(triggers, "event_id")
        .join(signals.select("signal_id", "source_id"), "signal_id")
        .join(sources.select("source_id", "perspective"), "source_id")
    )
    d = d.groupBy("edge_id").agg(
        F.countDistinct("perspective").alias("n_perspectives"), F.countDistinct("signal_id").alias("n_signals")
    )
    return d.withColumn("pools", F.when(F.col("n_perspectives") > 1, "several").otherwise("one"))
