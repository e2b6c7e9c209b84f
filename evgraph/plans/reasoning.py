"""Drill-downs of nodes and edges at a past moment (ASO-04/05)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.functions.bands import band_ord
from evgraph.operators.asof import recent_history
from evgraph.operators.ordered import top_per_key
from evgraph.plans.changes import named_edges


def node_edges(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, *, as_of: datetime) -> DataFrame:
    """Live edges of the wanted nodes created by ``as_of``, with names and the band's ordinal.

    Consumers order by ordinal descending, then newest: disputed comes first.
    """
    live = edges.filter(~F.col("deprecated") & (F.col("created_at") <= F.lit(as_of)))
    ends = live.withColumn("node_id", F.explode(F.array("source_node_id", "target_node_id")))
    d = ends.join(wanted.select("node_id"), "node_id", "left_semi")
    return named_edges(d, nodes).withColumn("band_ord", band_ord(F.col("current_weight_band")))


def cited_signals(links: DataFrame, signals: DataFrame, payloads: DataFrame, key: str, n: int = 20) -> DataFrame:
    """JOI-03/07/08: newest ``n`` signals per key with the source of their payload.

    ``links`` holds the key and signal_id, one row per array element.
    """
    d = links.select(key, "signal_id").distinct().join(
        signals.select("signal_id", "payload_id", "lens_id", "claim_text", "confidence_band",
                       "content_timestamp"), "signal_id"
    )
    d = top_per_key(d, [key], [F.col("content_timestamp").desc(), F.col("signal_id").desc()], n)
    return d.join(payloads.select("payload_id", "source_id"), "payload_id", "left")


def node_drilldown(
    nodes: DataFrame, edges: DataFrame, state_history: DataFrame, wanted: DataFrame, *, as_of: datetime
) -> dict[str, DataFrame]:
    """ASO-04: node rows, their live edges and last 20 state changes by ``as_of``."""
    keys = wanted.select("node_id")
    return {
        "node": nodes.join(keys, "node_id", "left_semi"),
        "edges": node_edges(nodes, edges, wanted, as_of=as_of),
        "states": recent_history(
            state_history.join(keys, "node_id", "left_semi"), "node_id", 20, as_of
        ),
    }


def edge_drilldown(
    nodes: DataFrame,
    edges: DataFrame,
    weight_history: DataFrame,
    challenges: DataFrame,
    support: DataFrame,
    signals: DataFrame,
    payloads: DataFrame,
    wanted: DataFrame,
    *,
    as_of: datetime,
) -> dict[str, DataFrame]:
    """ASO-05: edge with endpoints, last 30 weight changes, 20 signals per side, 10 challenges.

    ``support`` holds edge_id, signal_id and supporting.
    """
    keys = wanted.select("edge_id")
    mine = lambda d: d.join(keys, "edge_id", "left_semi")
    return {
        "edge": named_edges(mine(edges.filter(F.col("created_at") <= F.lit(as_of))), nodes),
        "weights": recent_history(mine(weight_history), "edge_id", 30, as_of),
        "supporting": cited_signals(mine(support.filter("supporting")), signals, payloads, "edge_id"),
        "disconfirming": cited_signals(
            mine(support.filter("NOT supporting")), signals, payloads, "edge_id"
        ),
        "challenges": top_per_key(
            mine(challenges), ["edge_id"],
            [F.col("challenged_at").desc(), F.col("pass_event_id").desc()], 10,
        ),
    }
