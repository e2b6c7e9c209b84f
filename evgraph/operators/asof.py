"""Reads as of a past moment from the append-only histories (ASO)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.operators.ordered import top_per_key


def value_as_of(history: DataFrame, key: str, value: str, as_of) -> DataFrame:
    """ASO-01/06: newest ``value`` per key with content time <= ``as_of``, ties by id."""
    return (
        history.filter(F.col("content_timestamp") <= F.lit(as_of))
        .groupBy(key)
        .agg(F.max_by(value, F.struct("content_timestamp", "id")).alias(value))
    )


def edges_as_of(edges: DataFrame, weight_history: DataFrame, as_of) -> DataFrame:
    """ASO-02: edges created by ``as_of`` with the band of that moment.

    The stored band stays when no history row qualifies.
    """
    band = value_as_of(weight_history, "edge_id", "weight_band", as_of)
    return (
        edges.filter(F.col("created_at") <= F.lit(as_of))
        .join(band, "edge_id", "left")
        .withColumn("current_weight_band", F.coalesce("weight_band", "current_weight_band"))
        .drop("weight_band")
    )


def nodes_as_of(nodes: DataFrame, state_history: DataFrame, as_of) -> DataFrame:
    """ASO-06: nodes created by ``as_of`` with the state of that moment."""
    state = value_as_of(state_history, "node_id", "new_state", as_of)
    return (
        nodes.filter(F.col("created_at") <= F.lit(as_of))
        .join(state, "node_id", "left")
        .withColumn("current_state", F.coalesce("new_state", "current_state"))
        .drop("new_state")
    )


def recent_history(history: DataFrame, key: str, n: int, as_of=None) -> DataFrame:
    """ASO-03: newest ``n`` history rows per key, optionally up to a moment."""
    d = history if as_of is None else history.filter(F.col("content_timestamp") <= F.lit(as_of))
    return top_per_key(d, [key], [F.col("content_timestamp").desc(), F.col("id").desc()], n)


# --- keyed lookups of the graph reader -----------------------------------------

def nodes_by_key(nodes: DataFrame, keys: DataFrame, as_of=None) -> DataFrame:
    """FLT-09: the requested nodes, optionally only those created by ``as_of``."""
    d = nodes if as_of is None else nodes.filter(F.col("created_at") <= F.lit(as_of))
    return d.join(keys.select("node_id"), "node_id", "left_semi")


def nodes_of_type(nodes: DataFrame, node_type: str, *, as_of=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """FLT-10: one page of the nodes of a type, newest first."""
    d = nodes.filter(F.col("node_type") == node_type)
    if as_of is not None:
        d = d.filter(F.col("created_at") <= F.lit(as_of))
    return d.orderBy(F.col("created_at").desc(), "node_id").offset(offset).limit(limit)


def edges_by_key(edges: DataFrame, weight_history: DataFrame, keys: DataFrame, as_of=None) -> DataFrame:
    """FLT-11: live edges now, or any edge created by ``as_of`` with its band then."""
    wanted = edges.join(keys.select("edge_id"), "edge_id", "left_semi")
    if as_of is None:
        return wanted.filter(~F.col("deprecated"))
    return edges_as_of(wanted, weight_history, as_of)


def edges_of_nodes(
    edges: DataFrame,
    nodes: DataFrame,
    *,
    direction: str = "both",
    edge_type: str | None = None,
    weight_history: DataFrame | None = None,
    as_of=None,
) -> DataFrame:
    """FLT-12: edges leaving, entering or touching the given nodes, with ``node_id``."""
    d = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    d = d.filter(~F.col("deprecated")) if as_of is None else edges_as_of(d, weight_history, as_of)
    ends = {"out": ["source_node_id"], "in": ["target_node_id"]}.get(
        direction, ["source_node_id", "target_node_id"]
    )
    side = d.withColumn("node_id", F.explode(F.array(*ends)))
    return side.join(nodes.select("node_id"), "node_id", "left_semi")
