"""Dimension scores, weekly series, velocity and the overall verdict (DIM)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.functions.bands import is_high, state_band
from evgraph.functions.text import all_dimensions, dimension_label, lookup
from evgraph.operators.asof import nodes_as_of
from evgraph.operators.ordered import top_per_key
from evgraph.session import literal_table


def _dimensions(spark) -> DataFrame:
    return literal_table(spark, [(d,) for d in vocab.DIMENSIONS], "dimension string")


def condition_dimensions(nodes: DataFrame, as_of: datetime) -> DataFrame:
    """SIM-08: one row per condition created by ``as_of`` and matching dimension."""
    text = F.concat("name", F.lit(" "), F.coalesce("description", F.lit("")))
    return nodes.filter(
        (F.col("node_type") == "condition") & (F.col("created_at") <= F.lit(as_of))
    ).select("node_id", "current_state", F.explode(all_dimensions(text)).alias("dimension"))


def edge_strength(edges: DataFrame, as_of: datetime) -> DataFrame:
    """Strong/moderate and other live edges per node, an edge counting at both ends."""
    live = edges.filter(~F.col("deprecated") & (F.col("created_at") <= F.lit(as_of)))
    ends = live.select(
        F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"),
        is_high(F.col("current_weight_band")).alias("high"),
    )
    return ends.groupBy("node_id").agg(
        F.count_if("high").alias("strong"), F.count_if(~F.col("high")).alias("weak")
    )


def window_states(history: DataFrame, as_of: datetime) -> DataFrame:
    """WIN-04: newest state per node in the last 14 days and in the 14 days before.

    The recent window includes both bounds; the prior one excludes its end.
    """
    recent_from = F.lit(as_of - timedelta(days=14))
    in_recent = F.col("content_timestamp") >= recent_from
    order = F.struct("content_timestamp", "id")
    return (
        history.filter(
            F.col("content_timestamp").between(F.lit(as_of - timedelta(days=28)), F.lit(as_of))
        )
        .groupBy("node_id")
        .agg(
            F.max_by(F.when(in_recent, F.col("new_state")), F.when(in_recent, order)).alias("recent"),
            F.max_by(F.when(~in_recent, F.col("new_state")), F.when(~in_recent, order)).alias("prior"),
        )
    )


def weekly_series(nodes: DataFrame, history: DataFrame, as_of: datetime) -> DataFrame:
    """WIN-05: changes and active changes per dimension and Monday week, 91 days back.

    Counted per node and week before the dimensions are attached.  A node that is
    not known counts under the default dimension.
    """
    per_node = (
        history.filter(
            F.col("content_timestamp").between(F.lit(as_of - timedelta(days=91)), F.lit(as_of))
        )
        .groupBy("node_id", F.date_trunc("week", "content_timestamp").alias("week_start"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("new_state") == "active").alias("a"))
    )
    dims = condition_dimensions(nodes, as_of).select("node_id", "dimension")
    return (
        per_node.join(dims, "node_id", "left")
        .groupBy(F.coalesce("dimension", F.lit(vocab.DEFAULT_DIMENSION)).alias("dimension"), "week_start")
        .agg(F.sum("a").alias("active_count"), F.sum("n").alias("total_count"))
    )


def velocity(series: DataFrame) -> DataFrame:
    """WIN-06..08, DIM-04: rate and acceleration of the weekly active share.

    Least squares over the last six weeks with data.  With four or more, the
    slope of the recent part is compared with that of the leading part.
    """
    share = series.filter("total_count > 0").withColumn(
        "share", F.col("active_count") / F.col("total_count")
    )
    all_weeks = share.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_all"))
    last = top_per_key(share, ["dimension"], [F.col("week_start").desc()], 6)
    w = W.partitionBy("dimension")
    last = last.withColumn("i", F.row_number().over(w.orderBy("week_start")) - 1)
    last = last.withColumn("n", F.count(F.lit(1)).over(w))
    half = F.floor(F.col("n") / 2)
    x = F.col("i").cast("double")

    def slope(cond):
        y = F.when(cond, F.col("share"))
        return F.coalesce(F.regr_slope(y, F.when(cond, x)), F.lit(0.0))

    fit = last.groupBy("dimension").agg(
        F.max("n").alias("n"),
        slope(F.lit(True)).alias("rate"),
        slope(F.col("i") < F.col("n") - half).alias("lead"),
        slope(F.col("i") >= half).alias("tail"),
    ).join(all_weeks, "dimension")
    enough = F.col("n_all") >= 3
    split = enough & (F.col("n") >= 4)
    size = (
        F.when(F.abs("rate") < 0.02, "gentle").when(F.abs("rate") < 0.05, "moderate").otherwise("steep")
    )
    turn = F.when(F.col("rate") > 0, "rising").otherwise("easing")
    gain = F.abs("tail") - F.abs("lead")
    d = fit.select(
        "dimension",
        F.when(enough, F.round("rate", 4)).otherwise(0.0).alias("rate"),
        F.when(~enough, "insufficient data").when(F.abs("rate") < 0.005, "steady")
        .otherwise(F.concat_ws(" ", size, turn)).alias("rate_label"),
        F.when(split, F.round(F.col("tail") - F.col("lead"), 4)).otherwise(0.0).alias("acceleration"),
        F.when(~split, "—").when(F.abs(gain) < 0.005, "linear").when(gain > 0, "accelerating")
        .otherwise("decelerating").alias("accel_label"),
    )
    return _dimensions(series.sparkSession).join(d, "dimension", "left").fillna(
        {"rate": 0.0, "rate_label": "insufficient data", "acceleration": 0.0, "accel_label": "—"}
    )


def dimension_scores(
    nodes: DataFrame,
    edges: DataFrame,
    state_history: DataFrame,
    *,
    as_of: datetime,
    state_mode: str = "current",
) -> DataFrame:
    """DIM-01..04: one row for each of the five dimensions.

    ``state_mode='current'`` uses today's condition states, as the pipeline does;
    ``'as_of'`` takes them from the history.
    """
    if state_mode == "as_of":
        nodes = nodes_as_of(nodes, state_history, as_of)
    members = condition_dimensions(nodes, as_of)
    states = window_states(state_history, as_of)
    # Whether any node moved in the 28 days decides between "steady" and "unknown".
    moved = states.agg(
        F.count(F.when(F.col("recent").isNotNull() | F.col("prior").isNotNull(), 1)).alias("n_moved")
    )
    d = (
        members.join(edge_strength(edges, as_of), "node_id", "left")
        .join(states, "node_id", "left")
        .groupBy("dimension")
        .agg(
            F.count(F.lit(1)).alias("total_conditions"),
            F.count_if(F.col("current_state") == "active").alias("active_conditions"),
            F.coalesce(F.sum("strong"), F.lit(0)).alias("strong_edge_count"),
            F.coalesce(F.sum("weak"), F.lit(0)).alias("weak_edge_count"),
            (F.count_if(F.col("recent") == "active") - F.count_if(F.col("prior") == "active"))
            .alias("delta"),
        )
    )
    counts = ["total_conditions", "active_conditions", "strong_edge_count", "weak_edge_count", "delta"]
    d = _dimensions(nodes.sparkSession).join(d, "dimension", "left").fillna(0, counts)
    # One row on the right: a single count.
    d = d.join(F.broadcast(moved))
    direction = (
        F.when((F.col("total_conditions") == 0) | (F.col("n_moved") == 0), "unknown")
        .when(F.col("delta") > 1, "worsening").when(F.col("delta") < -1, "improving")
        .otherwise("steady")
    )
    d = d.select(
        "dimension", dimension_label(F.col("dimension")).alias("label"),
        state_band(F.col("active_conditions"), F.col("total_conditions")).alias("state"),
        direction.alias("direction"), *counts[:4],
    )
    return d.join(velocity(weekly_series(nodes, state_history, as_of)), "dimension")


def verdict(scores: DataFrame) -> DataFrame:
    """DIM-05/06: composite, headline, counts by band and confidence regime, one row."""
    u = F.avg(lookup(vocab.BAND_SCORES, F.col("state"), F.lit(0.5)))
    d = scores.agg(
        F.round(u, 6).alias("composite"),
        F.sum("strong_edge_count").alias("strong"), F.sum("weak_edge_count").alias("weak"),
        F.bool_or(F.col("direction") == "improving").alias("up"),
        F.bool_or(F.col("direction") == "worsening").alias("down"),
        *[F.count_if(F.col("state") == b).alias(f"n_{b}")
          for b in ["improving", "stable", "strained", "deteriorating", "crisis"]],
    )
    # --- fixed values: headline limits and texts ---
    headline = (
        F.when(F.col("composite") < 0.2, "At present, yes.")
        .when(F.col("composite") < 0.4, "Holding, for now.")
        .when(F.col("composite") < 0.6, "Under pressure.")
        .when(F.col("composite") < 0.75, "Not at present.")
        .otherwise("Under serious stress.")
    )
    total = F.col("strong") + F.col("weak")
    share = F.col("strong") / total
    level = F.when(share < 0.33, "low").when(share < 0.66, "moderate").otherwise("high")
    spread = F.when(F.col("up") & F.col("down"), "widening").otherwise("aligned")
    parts = [
        F.when(F.col(f"n_{b}") > 0, F.concat_ws(" ", f"n_{b}", F.lit(b)))
        for b in ["improving", "stable", "strained", "deteriorating", "crisis"]
    ]
    return d.select(
        "composite", headline.alias("headline"),
        F.concat(F.concat_ws(", ", *parts), F.lit(".")).alias("subline"),
        F.when(total == 0, "unestablished").otherwise(F.concat_ws(", ", level, spread)).alias("regime"),
    )


def track_position(events: DataFrame, start, end) -> DataFrame:
    """WIN-12: place of each event on a time track, only those inside it."""
    span = F.unix_micros(F.lit(end)) - F.unix_micros(F.lit(start))
    pos = (F.unix_micros("occurred_at") - F.unix_micros(F.lit(start))) / span
    return events.withColumn("position", pos).filter(F.col("position").between(0, 1))
