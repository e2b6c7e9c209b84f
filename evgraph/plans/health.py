"""Operating views: pipeline health, batch quality, signal flow, graph totals (AGG-06..08, 14, 15)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.functions.bands import is_high
from evgraph.operators.ordered import top_per_key
from evgraph.session import side_by_side


def _after(column: str, now: datetime, **ago) -> Column:
    return F.col(column) > F.lit(now - timedelta(**ago))


def pipeline_health(
    signals: DataFrame, nodes: DataFrame, edges: DataFrame, payloads: DataFrame, *, now: datetime
) -> DataFrame:
    """AGG-06: one row of counts; each table is read once.

    ``signals`` carries cluster_id and extracted_at, ``nodes`` a deprecated flag,
    ``payloads`` a rejected flag.
    """
    s = signals.agg(
        F.count(F.lit(1)).alias("signals_total"),
        F.count_if(_after("extracted_at", now, hours=24)).alias("signals_24h"),
        F.count_if(_after("extracted_at", now, hours=4)).alias("signals_4h"),
        F.count_if(_after("extracted_at", now, hours=1)).alias("signals_1h"),
        F.count_if(F.col("cluster_id").isNull()).alias("unclustered"),
        F.count_if(F.col("cluster_id").isNotNull()).alias("clustered"),
        F.count_if(
            F.col("cluster_id").isNull() & (F.col("extracted_at") < F.lit(now - timedelta(hours=1)))
        ).alias("anchoring_backlog"),
    )
    n = nodes.agg(
        F.count_if(~F.col("deprecated")).alias("live_nodes"),
        F.count_if("deprecated").alias("deprecated_nodes"),
        F.count_if(~F.col("deprecated") & _after("created_at", now, hours=24)).alias("nodes_24h"),
    )
    last = F.col("last_disconfirmation_pass")
    e = edges.agg(
        F.count_if(~F.col("deprecated")).alias("live_edges"),
        F.count_if("deprecated").alias("deprecated_edges"),
        F.count_if(~F.col("deprecated") & _after("created_at", now, hours=24)).alias("edges_24h"),
        F.count_if(F.col("current_weight_band") == "strong").alias("strong_edges"),
        F.count_if(F.col("current_weight_band") == "disputed").alias("disputed_edges"),
        F.count_if(
            ~F.col("deprecated") & is_high(F.col("current_weight_band"))
            & (last.isNull() | (last < F.lit(now - timedelta(days=14))))
        ).alias("stale_edges"),
    )
    p = payloads.filter(_after("fetched_at", now, hours=24)).agg(
        F.count(F.lit(1)).alias("payloads_24h"),
        F.count_if(_after("fetched_at", now, hours=4)).alias("payloads_4h"),
        F.count_if("rejected").alias("payloads_rejected"),
    )
    return side_by_side(s, n, e, p)


def last_job_runs(runs: DataFrame, *, now: datetime, days: int = 7) -> DataFrame:
    """AGG-06: newest run per job of the last days."""
    return top_per_key(
        runs.filter(_after("started_at", now, days=days)), ["job_name"], [F.col("started_at").desc()], 1
    )


def batch_quality(events: DataFrame, *, now: datetime, days: int = 7, limit: int | None = None) -> DataFrame:
    """AGG-07: events, applied, rejected, start, lenses and rejection rate per batch."""
    d = events.filter(_after("applied_at", now, days=days)).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(~F.col("rejected")).alias("n_applied"),
        F.count_if("rejected").alias("n_rejected"),
        F.min("applied_at").alias("batch_start"),
        F.countDistinct("lens_id").alias("n_lenses"),
    ).withColumn("rejection_rate", F.round(F.col("n_rejected") / F.col("n_events"), 3))
    return d if limit is None else d.orderBy(F.col("batch_start").desc(), "batch_id").limit(limit)


def signal_flow(signals: DataFrame, *, now: datetime, hours: int = 24) -> DataFrame:
    """AGG-08: signals and distinct clusters per lens in the window, with a total row."""
    recent = signals.filter(F.col("extracted_at") >= F.lit(now - timedelta(hours=hours)))
    agg = [F.count(F.lit(1)).alias("n_signals"), F.countDistinct("cluster_id").alias("n_clusters")]
    return recent.groupBy("lens_id").agg(*agg).unionByName(
        recent.agg(*agg).withColumn("lens_id", F.lit("all"))
    )


def graph_totals(
    nodes: DataFrame, edges: DataFrame, aliases: DataFrame, names: list[str] | None = None
) -> DataFrame:
    """AGG-14: nodes, live edges, aliases and how many of the expected names exist."""
    wanted = names or []
    n = nodes.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.countDistinct(F.when(F.col("name").isin(wanted), F.col("name"))).alias("names_found"),
    )
    e = edges.agg(F.count_if(~F.col("deprecated")).alias("n_live_edges"))
    a = aliases.agg(F.count(F.lit(1)).alias("n_aliases"))
    return side_by_side(n, e, a)


def stored_per_source(payloads: DataFrame) -> DataFrame:
    """AGG-15: accepted payloads per source."""
    return payloads.groupBy("source_id").agg(F.count_if(~F.col("rejected")).alias("n_stored"))
