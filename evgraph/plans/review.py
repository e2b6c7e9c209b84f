"""Challenging strong edges: selection, responses, outcomes (DSC, FLT-19/20/30, AGG-12)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.functions.bands import band_rank, is_high
from evgraph.functions.text import strip
from evgraph.operators.mutate import ALIAS_SCHEMA, Graph, apply_batches
from evgraph.operators.similarity import near_lists
from evgraph.plans.changes import named_edges
from evgraph.session import literal_table, side_by_side

OPERATION_FIELDS = [
    "operation", "target_edge_id", "new_weight_band", "direction", "signal_id", "reasoning",
]
# --- fixed values: operations a challenge may propose ---
CHALLENGE_OPERATIONS = ["add_disconfirming_signal", "update_edge_weight"]


def challenge_candidates(
    edges: DataFrame, nodes: DataFrame, *, now: datetime, rechallenge_days: int = 7,
    limit: int | None = None,
) -> DataFrame:
    """DSC-01: live strong or moderate edges due for a challenge.

    Strong first, never challenged first, then longest ago, then newest update.
    """
    due = F.col("last_disconfirmation_pass").isNull() | (
        F.col("last_disconfirmation_pass") < F.lit(now - timedelta(days=rechallenge_days))
    )
    d = edges.filter(
        ~F.col("deprecated") & (F.col("falsification_criteria") != "")
        & is_high(F.col("current_weight_band")) & due
    )
    order = [
        band_rank(F.col("current_weight_band")),
        F.col("last_disconfirmation_pass").asc_nulls_first(),
        F.col("updated_at").desc(),
        F.col("edge_id"),
    ]
    # Endpoint names are joined to the cut list; both endpoints always exist.
    return named_edges(d if limit is None else d.orderBy(*order).limit(limit), nodes)


def inline_edges(edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """DSC-03: newest strong or moderate edges shown with every payload."""
    d = edges.filter(
        ~F.col("deprecated") & (F.col("falsification_criteria") != "")
        & is_high(F.col("current_weight_band"))
    )
    d = d if limit is None else d.orderBy(F.col("updated_at").desc(), "edge_id").limit(limit)
    return named_edges(d, nodes)


def stale_support(
    edges: DataFrame, support: DataFrame, signals: DataFrame, *, now: datetime, days: int = 30
) -> DataFrame:
    """DES-07: edges whose newest supporting signal is older than ``days``, or that have none."""
    newest = (
        support.select("edge_id", "signal_id").distinct()
        .join(signals.select("signal_id", "content_timestamp"), "signal_id")
        .groupBy("edge_id").agg(F.max("content_timestamp").alias("newest_support"))
    )
    cutoff = F.lit(now - timedelta(days=days))
    return (
        edges.filter(~F.col("deprecated") & is_high(F.col("current_weight_band")))
        .join(newest, "edge_id", "left")
        .filter(F.col("newest_support").isNull() | (F.col("newest_support") < cutoff))
    )


def survival(challenges: DataFrame) -> DataFrame:
    """DES-08: challenges, and those survived, per edge; failed calls do not count."""
    heard = F.col("outcome").isin("found", "not_found")
    return challenges.groupBy("edge_id").agg(
        F.count_if(heard).alias("times_challenged"),
        F.count_if(F.col("outcome") == "not_found").alias("times_survived"),
        F.max(F.when(heard, F.col("challenged_at"))).alias("last_challenged"),
    )


def challenge_totals(challenges: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """AGG-12: totals of a pass; with its graph ``events`` also operations applied and rejected."""
    totals = challenges.agg(
        F.count(F.lit(1)).alias("n_challenged"),
        *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("found", "not_found", "error")],
    )
    if events is None:
        return totals
    done = events.agg(
        F.count_if(~F.col("rejected")).alias("n_operations_applied"), F.count_if("rejected").alias("n_operations_rejected"))
    return side_by_side(totals, done)


def challenge_log(
    challenges: DataFrame, edges: DataFrame, nodes: DataFrame, *, outcome: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """FLT-30: newest challenges with the names of the edge's endpoints."""
    d = challenges if outcome is None else challenges.filter(F.col("outcome") == outcome)
    order = [F.col("challenged_at").desc(), F.col("pass_event_id").desc()]
    d = d.join(edges.select("edge_id", "edge_type", "source_node_id", "target_node_id"), "edge_id")
    return named_edges(d if limit is None else d.orderBy(*order).limit(limit), nodes)


def parse_challenges(responses: DataFrame) -> DataFrame:
    """FLT-19: outcome, reasoning and operations of landed challenge responses.

    A fenced object, else the text from the first brace to the last; anything
    else is an error.  Operations count only for ``found``.
    """
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    text = strip(F.col("body"))
    d = responses.withColumn(
        "__text", F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(text)
    )
    d = d.withColumn("__braces", F.regexp_extract("__text", r"(?s)\{.*\}", 0))
    d = d.withColumn("__whole", F.try_parse_json("__text")).withColumn(
        "__p", F.coalesce("__whole", F.when(F.col("__whole").isNull(), F.try_parse_json("__braces")))
    )
    p = F.col("__p")
    get = lambda path, kind: F.try_variant_get(p, path, kind)
    is_object = F.coalesce(F.schema_of_variant(p).startswith("OBJECT"), F.lit(False))
    known = get("$.outcome", "string").isin("found", "not_found")
    outcome = F.when(is_object & known, get("$.outcome", "string")).otherwise("error")
    reasoning = (
        F.when(is_object, F.substring(F.coalesce(get("$.reasoning", "string"), F.lit("")), 1, 2000))
        .when(p.isNotNull(), "LLM returned non-object JSON.")
        .when(F.col("__braces") != "", "Could not parse LLM output.")
        .otherwise("No JSON found in LLM output.")
    )
    none = F.array().cast("array<variant>")
    ops = F.transform(
        F.coalesce(F.when(outcome == "found", get("$.operations", "array<variant>")), none),
        lambda v: F.struct(*[
            F.try_variant_get(v, f"$.{n}", "string").alias(n) for n in OPERATION_FIELDS
        ]),
    )
    keep = [c for c in responses.columns if c != "body"]
    return d.select(
        *keep, outcome.alias("outcome"), reasoning.alias("reasoning"), ops.alias("operations")
    )


def challenge_operations(parsed: DataFrame) -> DataFrame:
    """FLT-20: allowed operations of challenge responses, one row each."""
    keep = [c for c in parsed.columns if c not in ("operations", "outcome", "reasoning")]
    # Without ``outer`` the optimizer filters by the size of the list first and parses each text again, for every row it came from.
    d = parsed.select(*keep, F.posexplode_outer("operations").alias("pos", "op"))
    return d.filter(F.col("op.operation").isin(CHALLENGE_OPERATIONS)).select(*keep, "pos", "op.*")


def run_pass(
    edges: DataFrame,
    nodes: DataFrame,
    signals: DataFrame,
    responses: DataFrame,
    *,
    now: datetime,
    limit: int | None = None,
    window_days: int = 7,
) -> dict[str, DataFrame]:
    """DSC-02: candidates, their signals, outcomes, graph events and the stamped edges.

    ``responses`` holds edge_id, body and failed (the call did not come back).
    """
    chosen = challenge_candidates(edges, nodes, now=now, limit=limit)
    recent = signals.filter(F.col("extracted_at") > F.lit(now - timedelta(days=window_days)))
    pointed, lists = near_lists(chosen, recent)
    near = pointed.join(lists, ["source", "target"]).select("edge_id", F.inline("near")).select("edge_id", "signal_id", "content_timestamp")
    # At most ten signals of an edge are named as the trigger: the head of its list, which only operations need.
    cited = lists.select("source", "target", F.array_sort(
        F.transform(F.slice("near", 1, 10), lambda s: s["signal_id"].cast("string"))).alias("triggered_by"))
    answered = chosen.select("edge_id", "current_weight_band").join(responses, "edge_id", "left")
    failed = F.coalesce("failed", F.col("body").isNull())
    parsed = parse_challenges(answered.filter(~failed))
    lost = answered.filter(failed).select(
        "edge_id", "current_weight_band", F.lit("error").alias("outcome"),
        F.lit("LLM call failed").alias("reasoning"),
    )
    ops = challenge_operations(parsed).join(pointed, "edge_id", "left").join(cited, ["source", "target"], "left").select(
        F.concat(F.lit("challenge|"), "edge_id").alias("batch_id"), F.lit(now).alias("batch_time"),
        F.col("pos").cast("long").alias("pos"), "operation", "target_edge_id", "new_weight_band",
        "direction", "signal_id", "reasoning", F.lit("disconfirmation").alias("source"),
        "triggered_by",
    )
    graph = Graph(
        nodes.select("node_id", "node_type", "name", "description",
                     F.lit(None).cast("map<string,string>").alias("type_data"),
                     "created_at", "updated_at"),
        edges,
        literal_table(nodes.sparkSession, [], ALIAS_SCHEMA),
    )
    events, after = apply_batches(ops, graph, id_pattern=r"^\S+$")
    log = parsed.select("edge_id", "outcome", "reasoning",
                        F.col("current_weight_band").alias("weight_band_at_challenge")).unionAll(
        lost.select("edge_id", "outcome", "reasoning", "current_weight_band")
    ).withColumn("challenged_at", F.lit(now))
    came_back = parsed.select("edge_id").distinct().withColumn("stamp", F.lit(now))
    stamped = after.edges.join(edges.select("edge_id", "last_disconfirmation_pass"), "edge_id", "left")
    stamped = stamped.join(came_back, "edge_id", "left").withColumn(
        "last_disconfirmation_pass", F.coalesce("stamp", "last_disconfirmation_pass")
    ).drop("stamp")
    return {"selected": chosen, "signals": near, "log": log, "events": events, "edges": stamped}
