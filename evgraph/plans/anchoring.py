"""Anchoring cycle: batches of signals, their graph context, responses, applied events (GRA-04/07, MUT-11)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.operators.components import batch_summary, form_batches, group_signals
from evgraph.operators.mutate import Graph, apply_batches
from evgraph.operators.ordered import range_buckets, running_total, top_per_key
from evgraph.operators.similarity import search_names
from evgraph.operators.traverse import context_roots, neighbourhood
from evgraph.plans.extract import response_operations
from evgraph.session import cut_lineage
from evgraph.sources.sinks import mark_anchored


def batch_context(
    names: DataFrame, nodes: DataFrame, edges: DataFrame, *, budget: int = 8_000, depth: int = 2
) -> DataFrame:
    """GRA-04/07: packed context lines per batch: batch_id, section, item, line, used.

    ``names`` holds batch_id, name_no and name.  The two best nodes per name are
    roots, up to six; the union of their neighbourhoods is listed, nodes up to 60 %
    of the budget and edges up to the whole.  Items come in id order.  Batches with
    the same roots have the same context, which is made once for them.
    """
    hits = search_names(names, "name", nodes, k=2).select(F.col("query").alias("name"), "node_id", "score")
    roots = context_roots(names, hits).select("batch_id", F.col("node_id").alias("root"))
    # A batch has at most two roots more than the six.
    sets = roots.groupBy("batch_id").agg(F.array_sort(F.collect_set("root")).alias("roots"))
    kinds = cut_lineage(sets.select("roots").distinct().withColumn("kind", F.monotonically_increasing_id()))
    of_batch = sets.join(kinds, "roots").select("batch_id", "kind")
    roots = kinds.select("kind", F.explode("roots").alias("root"))
    reached, found = neighbourhood(edges, roots.select("root").distinct(), depth)
    in_batch = cut_lineage(roots.join(reached, "root").select("kind", "node_id").distinct())
    at_edges = cut_lineage(roots.join(found, "root").select("kind", "edge_id").distinct())
    counts = (
        in_batch.groupBy("kind").agg(F.count(F.lit(1)).alias("n_nodes"))
        .join(at_edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n_edges")), "kind", "left")
        .fillna(0, ["n_edges"])
    )
    head = F.concat(F.lit("**Tier B subgraph** ("), "n_nodes", F.lit(" nodes, "), "n_edges",
                    F.lit(" edges)\n\n### Nodes"))
    counts = counts.select("kind", F.length(head).cast("long").alias("lead"))

    text = F.coalesce("description", F.lit(""))
    node_line = F.concat(
        F.lit("- ["), "node_type", F.lit("] **"), "name", F.lit("** (id="), "node_id", F.lit(")"),
        F.when(text != "", F.concat(F.lit(" — "), F.substring(text, 1, 120))).otherwise(""),
    )
    node_rows = in_batch.join(nodes, "node_id").select(
        "kind", F.col("node_id").alias("item"), node_line.alias("line")
    )
    listed = _pack(node_rows.join(counts, "kind"), int(budget * 0.6), least=len("- [] **** (id=)\n"))
    # A note of this length follows when the node list was cut short.
    used = listed.groupBy("kind").agg(F.max("used").alias("used"))
    cut = F.when(F.col("used") > budget * 0.6, F.length(F.lit("  *(node list truncated)*")) + 1).otherwise(0)
    lead = used.select(
        "kind", (F.col("used") + cut + F.length(F.lit("\n### Edges")) + 1).cast("long").alias("lead")
    )

    def extra(label: str, column: str, d: DataFrame) -> Column:
        if column not in d.columns:
            return F.lit("")
        value = F.coalesce(column, F.lit(""))
        return F.when(value != "", F.concat(F.lit(f"\n  *{label}*: "), F.substring(value, 1, 200))).otherwise("")

    edge_line = F.concat(
        F.lit("- "), "source_node_id", F.lit(" --"), "edge_type", F.lit("--> "), "target_node_id",
        F.lit(" ["), "current_weight_band", F.lit("] (id="), "edge_id", F.lit(")"),
        extra("reasoning", "reasoning", edges), extra("falsification", "falsification_criteria", edges),
    )
    edge_rows = at_edges.join(edges, "edge_id").select(
        "kind", F.col("edge_id").alias("item"), edge_line.alias("line")
    )
    linked = _pack(edge_rows.join(lead, "kind"), budget, least=len("-  ----> [] (id=)\n"))
    packed = listed.withColumn("section", F.lit("nodes")).unionByName(
        linked.withColumn("section", F.lit("edges"))
    )
    return of_batch.join(packed, "kind").drop("kind")


def _pack(rows: DataFrame, budget: int, least: int) -> DataFrame:
    """Lines within the budget, counting the ``lead`` characters before the section.

    The first line of a section is always kept.  No line is shorter than ``least``, its break
    included, so later ones than those the budget could hold at that length are out of reach.
    """
    rows = top_per_key(rows.filter("line IS NOT NULL"), ["kind"], [F.col("item")], budget // least + 2)
    d = range_buckets(rows, ["kind"], ["item"], "__piece").withColumn(
        "size", F.length("line").cast("long") + 1
    )
    d = running_total(d, ["kind"], ["item"], F.col("__piece"), "size", "sum")
    before = F.col("lead") + F.col("sum") - F.col("size")
    keep = (F.col("sum") == F.col("size")) | (before <= budget)
    return d.filter(keep).select(
        "kind", "item", "line", (F.col("lead") + F.col("sum")).alias("used")
    )


def make_batches(
    signals: DataFrame, entities: DataFrame, *, now: datetime, max_hold_hours: float | None = 6.0,
    force: bool = False,
) -> DataFrame:
    """Batches of unanchored signals with a text ``batch_id``, one row per signal."""
    grouped = group_signals(signals, entities)
    d = form_batches(grouped, now=now, max_hold_hours=max_hold_hours, force=force)
    return d.withColumn("batch_id", F.concat_ws("-", "group_id", "batch_no"))


def anchoring_cycle(
    batched: DataFrame, responses: DataFrame, graph: Graph, *, seq: int, **options
) -> dict[str, object]:
    """MUT-11: apply landed responses to the graph and mark their signals anchored.

    ``batched`` comes from :func:`make_batches`; ``responses`` holds batch_id and
    body.  Batches without a response stay unanchored and are tried again later.
    """
    answered = batched.join(responses.select("batch_id"), "batch_id", "left_semi")
    # A batch has at most twenty signals.
    sizes = answered.groupBy("batch_id").agg(
        F.min("content_timestamp").alias("batch_time"), F.count(F.lit(1)).alias("n_signals"),
        F.array_sort(F.collect_list(F.col("signal_id").cast("string"))).alias("triggered_by"),
    )
    operations, parsed = response_operations(responses)
    ops = operations.join(sizes.drop("n_signals"), "batch_id").withColumn("source", F.lit("anchoring"))
    events, after = apply_batches(ops.withColumn("pos", F.col("pos").cast("long")), graph, **options)
    per = events.groupBy("batch_id").agg(
        F.count_if(~F.col("rejected")).alias("n_applied"), F.count_if("rejected").alias("n_rejected")
    )
    report = sizes.select("batch_id", "n_signals").join(per, "batch_id", "left").join(
        parsed, "batch_id", "left"
    ).fillna(0, ["n_applied", "n_rejected"])
    return {
        "events": events, "graph": after, "report": report, "summary": batch_summary(batched),
        "states": mark_anchored(answered, seq),
    }
