"""Recent changes: three change streams in one ranked record type (CHG)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.functions.bands import is_high
from evgraph.functions.text import best_dimension, dimension_label, edge_verb, lookup
from evgraph.operators.ordered import previous_value
from evgraph.operators.traverse import blast_radius, degree
from evgraph.session import cut_lineage, literal_table

CHANGE_COLUMNS = [
    "change_id", "change_type", "summary", "dimension", "dimension_label", "occurred_at",
    "target_id", "target_type", "target_name", "weight_before", "weight_after", "impact_rank",
]


def with_previous(history: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add the value before each history row, ordered by (content time, id), hour by hour."""
    return previous_value(
        history, [key], ["content_timestamp", "id"], F.date_trunc("hour", "content_timestamp"),
        value, out,
    )


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JOI-01: edges with the names of both endpoints."""
    src = nodes.select(F.col("node_id").alias("source_node_id"), F.col("name").alias("source_name"))
    dst = nodes.select(F.col("node_id").alias("target_node_id"), F.col("name").alias("target_name"))
    return edges.join(src, "source_node_id").join(dst, "target_node_id")


def edge_phrase() -> Column:
    """Source name, verb, target name."""
    return F.concat_ws(" ", "source_name", edge_verb(F.col("edge_type")), "target_name")


def _record(d: DataFrame) -> DataFrame:
    return d.withColumn("dimension_label", dimension_label(F.col("dimension"))).withColumn(
        "impact_rank", lookup(vocab.IMPACT_RANKS, F.col("change_type"), F.lit(9))
    ).select(*CHANGE_COLUMNS)


def _newest(d: DataFrame, time: str, key: str, n: int | None) -> DataFrame:
    """TOP-02: optional cut to the newest rows before anything is joined for display."""
    return d if n is None else d.orderBy(F.col(time).desc(), F.col(key).desc()).limit(n)


def change_stream(
    nodes: DataFrame,
    edges: DataFrame,
    weight_history: DataFrame,
    state_history: DataFrame,
    *,
    as_of: datetime,
    hours: int = 24,
    caps: tuple[int | None, int | None, int | None] = (None, None, None),
) -> DataFrame:
    """SET-02: weight changes, state flips and new edges of the window as change records.

    Histories carry their previous value (``previous_weight_band``,
    ``previous_state``).  Bounds are inclusive.  ``caps`` cut each stream to
    its newest rows before the streams are ranked together, as the home view may do.
    """
    since, until = F.lit(as_of - timedelta(hours=hours)), F.lit(as_of)

    w = weight_history.filter(
        F.col("content_timestamp").between(since, until)
        & F.col("change_type").isin("strengthened", "weakened", "disconfirmation")
        & (is_high(F.col("weight_band"))
           | F.coalesce(is_high(F.col("previous_weight_band")), F.lit(False)))
    )
    live = edges.filter(~F.col("deprecated"))
    w = w.join(live.select("edge_id", "source_node_id", "target_node_id", "edge_type"), "edge_id")
    w = named_edges(_newest(w, "content_timestamp", "id", caps[0]), nodes)
    kind = (
        F.when(F.col("change_type") == "disconfirmation", "disconfirmation_weakened")
        .when(F.col("change_type") == "strengthened", "edge_strengthened")
        .otherwise("edge_weakened")
    )
    w = w.withColumn("change_type", kind).withColumn("target_name", edge_phrase())
    lead = (
        F.when(F.col("change_type") == "disconfirmation_weakened", F.lit("Disconfirmation weakened"))
        .when(F.col("change_type") == "edge_strengthened",
              F.concat(F.lit("Strengthened to "), "weight_band"))
        .otherwise(F.concat(F.lit("Weakened to "), "weight_band"))
    )
    w = w.select(
        F.concat(F.lit("ewh-"), "id").alias("change_id"), "change_type",
        F.concat(lead, F.lit(": "), "target_name", F.lit(".")).alias("summary"),
        best_dimension(F.col("target_name")).alias("dimension"),
        F.col("content_timestamp").alias("occurred_at"), F.col("edge_id").alias("target_id"),
        F.lit("edge").alias("target_type"), "target_name",
        F.col("previous_weight_band").alias("weight_before"),
        F.col("weight_band").alias("weight_after"),
    )

    s = state_history.filter(
        F.col("content_timestamp").between(since, until)
        & F.col("new_state").isin("active", "inactive")
        & (F.col("previous_state").isNull() | (F.col("previous_state") != F.col("new_state")))
    ).join(nodes.select("node_id", "name", "description"), "node_id")
    s = _newest(s, "content_timestamp", "id", caps[1])
    s = s.withColumn(
        "change_type",
        F.when(F.col("new_state") == "active", "condition_activated")
        .otherwise("condition_deactivated"),
    )
    verb = F.when(F.col("new_state") == "active", "activated").otherwise("deactivated")
    s = s.select(
        F.concat(F.lit("csh-"), "id").alias("change_id"), "change_type",
        F.concat(F.lit("Condition "), verb, F.lit(": "), "name", F.lit(".")).alias("summary"),
        best_dimension(F.concat("name", F.lit(" "), F.coalesce("description", F.lit(""))))
        .alias("dimension"),
        F.col("content_timestamp").alias("occurred_at"), F.col("node_id").alias("target_id"),
        F.lit("node").alias("target_type"), F.col("name").alias("target_name"),
        F.lit(None).cast("string").alias("weight_before"),
        F.lit(None).cast("string").alias("weight_after"),
    )

    e = live.filter(
        F.col("created_at").between(since, until) & is_high(F.col("current_weight_band"))
    )
    e = named_edges(_newest(e, "created_at", "edge_id", caps[2]), nodes)
    e = e.withColumn("target_name", edge_phrase())
    e = e.select(
        F.concat(F.lit("edge-new-"), "edge_id").alias("change_id"),
        F.lit("edge_created").alias("change_type"),
        F.concat(F.lit("New "), "current_weight_band", F.lit(" link established: "),
                 "target_name", F.lit(".")).alias("summary"),
        best_dimension(F.col("target_name")).alias("dimension"),
        F.col("created_at").alias("occurred_at"), F.col("edge_id").alias("target_id"),
        F.lit("edge").alias("target_type"), "target_name",
        F.lit(None).cast("string").alias("weight_before"),
        F.col("current_weight_band").alias("weight_after"),
    )
    return _record(w).unionByName(_record(s)).unionByName(_record(e)).dropDuplicates(["change_id"])


def new_event_changes(
    nodes: DataFrame, edges: DataFrame, *, as_of: datetime, hours: int = 24
) -> DataFrame:
    """DES-12: event nodes created in the window that touch an active condition."""
    since, until = F.lit(as_of - timedelta(hours=hours)), F.lit(as_of)
    events = nodes.filter(
        (F.col("node_type") == "event") & F.col("created_at").between(since, until)
    )
    active = nodes.filter(
        (F.col("node_type") == "condition") & (F.col("current_state") == "active")
    ).select("node_id")
    live = edges.filter(~F.col("deprecated"))
    pairs = live.select("source_node_id", "target_node_id").unionAll(
        live.select("target_node_id", "source_node_id")
    ).toDF("node_id", "other")
    touching = (
        pairs.join(active.withColumnRenamed("node_id", "other"), "other", "left_semi")
        .select("node_id").distinct()
    )
    d = events.join(touching, "node_id", "left_semi").select(
        F.concat(F.lit("event-new-"), "node_id").alias("change_id"),
        F.lit("event_connected").alias("change_type"),
        F.concat(F.lit("New event: "), "name", F.lit(".")).alias("summary"),
        best_dimension(F.concat("name", F.lit(" "), F.coalesce("description", F.lit(""))))
        .alias("dimension"),
        F.col("created_at").alias("occurred_at"), F.col("node_id").alias("target_id"),
        F.lit("node").alias("target_type"), F.col("name").alias("target_name"),
        F.lit(None).cast("string").alias("weight_before"),
        F.lit(None).cast("string").alias("weight_after"),
    )
    return _record(d)


def rank_changes(changes: DataFrame, limit: int | None = 15, newest_first: bool = False) -> DataFrame:
    """TOP-01: by impact, then time (oldest first unless asked otherwise), then id."""
    time = F.col("occurred_at").desc() if newest_first else F.col("occurred_at")
    d = changes.orderBy("impact_rank", time, "change_id")
    return d if limit is None else d.limit(limit)


def attach_counts(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRA-01/02 on a change set: live edges around each target."""
    wanted = edges.join(
        changes.filter("target_type = 'edge'").select(F.col("target_id").alias("edge_id")).distinct(),
        "edge_id",
        "left_semi",
    )
    around = blast_radius(edges, wanted).select(
        F.lit("edge").alias("target_type"), F.col("edge_id").alias("target_id"),
        F.col("blast_radius").alias("downstream_edge_count"),
    )
    nodes = degree(edges).select(
        F.lit("node").alias("target_type"), F.col("node_id").alias("target_id"),
        F.col("degree").alias("downstream_edge_count"),
    )
    return changes.join(around.unionAll(nodes), ["target_type", "target_id"], "left").withColumn(
        "downstream_edge_count", F.coalesce("downstream_edge_count", F.lit(0))
    )


def topics_of_targets(
    changes: DataFrame, edges: DataFrame, topic_nodes: DataFrame, carried: tuple[str, ...] = ()
) -> DataFrame:
    """CHG-03: (change_id, topic_id) pairs; an edge belongs to the topics of both ends.

    The either-end condition is a union of equi-joins rather than an OR join.  Columns
    ``carried`` come along with their change.
    """
    at_nodes = changes.filter("target_type = 'node'").select(
        "change_id", *carried, F.col("target_id").alias("node_id")
    )
    at_edges = (
        changes.filter("target_type = 'edge'").select("change_id", *carried, F.col("target_id").alias("edge_id"))
        .join(edges.select("edge_id", "source_node_id", "target_node_id"), "edge_id")
        .select("change_id", *carried, F.explode(F.array("source_node_id", "target_node_id")).alias("node_id"))
    )
    return (
        at_nodes.unionAll(at_edges).join(topic_nodes.select("topic_id", "node_id"), "node_id")
        .select("change_id", "topic_id", *carried).distinct()
    )


def attach_topics(changes: DataFrame, edges: DataFrame, topic_nodes: DataFrame) -> DataFrame:
    """SET-05: topic ids per change as a sorted array (a change meets few topics)."""
    ids = (
        topics_of_targets(changes, edges, topic_nodes).groupBy("change_id")
        .agg(F.array_sort(F.collect_set("topic_id")).alias("topic_ids"))
    )
    return changes.join(ids, "change_id", "left").withColumn(
        "topic_ids", F.coalesce("topic_ids", F.array().cast("array<string>"))
    )


def recent_changes(
    nodes: DataFrame,
    edges: DataFrame,
    weight_history: DataFrame,
    state_history: DataFrame,
    topic_nodes: DataFrame | None = None,
    *,
    as_of: datetime,
    hours: int = 24,
    limit: int | None = 15,
    newest_first: bool = False,
    caps: tuple[int | None, int | None, int | None] = (None, None, None),
) -> DataFrame:
    """CHG-01: the ranked change list of the home view, with blast radius and topics."""
    d = change_stream(nodes, edges, weight_history, state_history, as_of=as_of, hours=hours, caps=caps)
    # Cut first, enrich after: the short list is written once and read by every lookup.
    d = attach_counts(cut_lineage(rank_changes(d, limit, newest_first)), edges)
    return d if topic_nodes is None else attach_topics(d, edges, topic_nodes)


def changes_by_topic(changes: DataFrame, edges: DataFrame, topic_nodes: DataFrame) -> DataFrame:
    """TPC-03: number and newest time of changes per topic.

    Only what is counted is written, so no text is built or searched for dimensions.
    """
    counted = ("occurred_at", "impact_rank")
    changes = cut_lineage(changes.select("change_id", "target_type", "target_id", *counted))
    return (
        topics_of_targets(changes, edges, topic_nodes, counted)
        .groupBy("topic_id")
        .agg(F.count(F.lit(1)).alias("n_changes"), F.max("occurred_at").alias("last_change"),
             F.min("impact_rank").alias("best_rank"))
    )


def change_basis(changes: DataFrame) -> DataFrame:
    """CHG-04: digest of the sorted change ids per dimension, every dimension present.

    Applied to the ranked and limited list, so a dimension holds few ids.
    """
    spark = changes.sparkSession
    dims = literal_table(spark, [(d,) for d in vocab.DIMENSIONS], "dimension string")
    ids = changes.groupBy("dimension").agg(F.array_sort(F.collect_list("change_id")).alias("ids"))
    joined = F.array_join(F.coalesce("ids", F.array().cast("array<string>")), "|")
    return dims.join(ids, "dimension", "left").select(
        "dimension",
        F.coalesce(F.size("ids"), F.lit(0)).alias("n_changes"),
        F.substring(F.sha2(joined, 256), 1, 16).alias("basis_hash"),
    )


def note_updates(basis: DataFrame, cached: DataFrame) -> DataFrame:
    """SNK-10: what to do with each dimension's cached note.

    ``unchanged`` when the digest is the cached one, ``cleared`` when nothing
    changed in the window, otherwise ``regenerate``.
    """
    old = cached.select("dimension", F.col("basis_hash").alias("cached_hash"))
    status = (
        F.when(F.col("basis_hash").eqNullSafe(F.col("cached_hash")), "unchanged")
        .when(F.col("n_changes") == 0, "cleared")
        .otherwise("regenerate")
    )
    return basis.join(old, "dimension", "full_outer").withColumn("status", status)


def apply_notes(updates: DataFrame, cached: DataFrame, written: DataFrame, now) -> DataFrame:
    """SNK-10: note table after a refresh, one row per dimension.

    ``written`` holds dimension and note for regenerated dimensions; a missing or
    empty note leaves the cached row as it is.
    """
    d = updates.select("dimension", "status", "basis_hash").join(
        written.select("dimension", F.substring("note", 1, 280).alias("new_note")), "dimension", "left"
    ).join(cached.select("dimension", "note", F.col("basis_hash").alias("old_hash"), "generated_at"),
           "dimension", "left")
    fresh = (F.col("status") == "regenerate") & (F.coalesce(F.length("new_note"), F.lit(0)) > 0)
    clear = F.col("status") == "cleared"
    return d.select(
        "dimension",
        F.when(clear, "").when(fresh, F.col("new_note")).otherwise(F.col("note")).alias("note"),
        F.when(clear | fresh, F.col("basis_hash")).otherwise(F.col("old_hash")).alias("basis_hash"),
        F.when(clear | fresh, F.lit(now)).otherwise(F.col("generated_at")).alias("generated_at"),
    ).filter(F.col("basis_hash").isNotNull())
