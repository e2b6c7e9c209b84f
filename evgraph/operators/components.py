"""Topical grouping: connected components and batch windows (GRA-05/06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evgraph.functions.text import strip
from evgraph.operators.ordered import join_summary, number_rows, range_buckets
from evgraph.session import cut_lineage


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest member of the connected component of each node.

    ``links`` holds ``a`` and ``b``; returns ``node``, ``root`` for every node of
    a link.  Alternates large-star and small-star steps, which shrink any shape
    of graph in a number of rounds that grows with the logarithm of its size.
    Each step is one minimum per node and one join; no neighbour list is built and
    the rows of a hub are split over tasks.
    """
    edges = cut_lineage(
        links.select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        ).distinct()
    )
    nodes = edges.select(F.col("u").alias("node")).unionAll(edges.select("v")).distinct()
    stars = edges.filter("u <> v")
    previous, n = None, edges.count()
    for _ in range(max_rounds):
        # A large star writes at most one row per end of an edge.
        stars = cut_lineage(_small_star(_large_star(stars, 2 * n), 2 * n))
        # Row count and a digest of the rows tell whether a round changed anything.
        state = stars.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")
        ).first()
        if state == previous:
            break
        previous, n = state, state["n"]
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return nodes.join(stars, nodes["node"] == stars["u"], "left").select(
        "node", F.coalesce("v", "node").alias("root")
    )


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect each larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("u", "v").unionAll(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    )
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(
        "u", F.least("u", "m").alias("m"), "n"
    )
    return (
        join_summary(both, low, ["u"], "n", "inner", total=total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v").distinct()
    )


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_summary(down, low, ["u"], "n", "inner", total=total).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def group_signals(signals: DataFrame, entities: DataFrame) -> DataFrame:
    """GRA-05: group id per signal; signals that share an entity name are together.

    ``entities`` holds signal_id and name, one row per name.  Names are linked
    rather than signals: a signal with several names links its smallest name to
    the others, so the graph has as many nodes as there are names.  The group id
    is the smallest signal id of the group, found per pair of names, so that signals are
    met by their names and not by their group, which may hold almost all of them.
    """
    names = entities.select("signal_id", F.lower(strip(F.col("name"))).alias("name")).filter(
        "name <> ''"
    )
    here = signals.select("signal_id", F.lit(True).alias("here"))
    inside = W.partitionBy("signal_id").orderBy("name")
    named = names.withColumn("first", F.first("name").over(inside))
    pairs = cut_lineage(
        named.join(here, "signal_id", "left").groupBy("first", "name")
        .agg(F.min(F.when(F.col("here"), F.col("signal_id"))).alias("low"))
    )
    roots = cut_lineage(components(pairs.select(F.col("first").alias("a"), F.col("name").alias("b"))))
    smallest = (
        pairs.join(roots, pairs["first"] == roots["node"]).groupBy("root").agg(F.min("low").alias("group_id"))
    )
    groups = roots.join(smallest, "root").select(F.col("node").alias("first"), "group_id")
    grouped = names.groupBy("signal_id").agg(F.min("name").alias("first")).join(groups, "first").select("signal_id", "group_id")
    return signals.join(grouped, "signal_id", "left").withColumn(
        "group_id", F.coalesce("group_id", "signal_id")
    )


def form_batches(
    grouped: DataFrame,
    *,
    now,
    size: int = 20,
    minimum: int = 2,
    max_hold_hours: float | None = None,
    force: bool = False,
) -> DataFrame:
    """GRA-06: windows of ``size`` signals per group; small ones wait unless overdue.

    Signals are taken newest content first, the order they are pulled in, ties by
    signal id.  One group may hold a large share of all signals, so the order is cut
    into even ranges and only ids and times are numbered.  Returns one row per
    signal with ``batch_no``.
    """
    narrow = grouped.select(
        "group_id", "signal_id", (-F.unix_micros("content_timestamp")).alias("__age")
    )
    order = ["__age", "signal_id"]
    narrow = range_buckets(narrow, ["group_id"], order, "__piece")
    numbered = number_rows(narrow, ["group_id"], order, F.col("__piece")).select(
        "signal_id", F.floor((F.col("rn") - 1) / size).alias("batch_no")
    )
    d = grouped.join(numbered, "signal_id")
    if force:
        return d
    sizes = d.groupBy("group_id", "batch_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("extracted_at").alias("oldest")
    )
    keep = F.col("n") >= minimum
    if max_hold_hours is not None:
        waited = F.unix_micros(F.lit(now)) - F.unix_micros("oldest")
        keep = keep | (waited >= F.lit(max_hold_hours * 3_600_000_000))
    return d.join(sizes.filter(keep).select("group_id", "batch_no"), ["group_id", "batch_no"])


def batch_summary(batches: DataFrame) -> DataFrame:
    """Size, lenses, oldest content time per batch; a batch has at most 20 signals."""
    return batches.groupBy("group_id", "batch_no").agg(
        F.count(F.lit(1)).alias("n_signals"),
        F.array_join(F.array_sort(F.collect_set("lens_id")), "|").alias("lens_ids"),
        F.min("content_timestamp").alias("content_timestamp"),
        F.min("extracted_at").alias("oldest_extracted_at"),
    )
