"""Outcome of signals, scores of sources and lenses, leakage, report (CAL, AGG-01..05)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.functions.text import lookup
from evgraph.operators.ordered import top_per_key
from evgraph.session import side_by_side


def register(tracking: DataFrame | None, signals: DataFrame, run_id: str) -> DataFrame:
    """SNK-07: pending rows to append for signals a run does not track yet."""
    new = signals.select(
        F.lit(run_id).alias("run_id"), "signal_id", F.coalesce("source_id", F.lit("")).alias("source_id"),
        "lens_id", "content_timestamp", F.lit("pending").alias("outcome"),
        F.lit(None).cast("double").alias("score"),
    ).dropDuplicates(["signal_id"])
    if tracking is None:
        return new
    return new.join(tracking.select("run_id", "signal_id"), ["run_id", "signal_id"], "left_anti")


def last_five(weight_history: DataFrame) -> DataFrame:
    """WIN-03: which change types occur among the newest five changes of each edge."""
    d = top_per_key(
        weight_history.select("edge_id", "id", "change_type", "content_timestamp"), ["edge_id"],
        [F.col("content_timestamp").desc(), F.col("id").desc()], 5,
    )
    return d.groupBy("edge_id").agg(
        F.bool_or(F.col("change_type") == "strengthened").alias("up"),
        F.bool_or(F.col("change_type").isin("weakened", "disconfirmation")).alias("down"),
    )


def edge_verdicts(edges: DataFrame, weight_history: DataFrame) -> DataFrame:
    """Outcome an edge gives the signals that were anchored on it, per edge with a row or a history."""
    d = edges.select("edge_id", "deprecated").join(last_five(weight_history), "edge_id", "full_outer")
    yes = lambda c: F.coalesce(c, F.lit(False))
    verdict = (
        F.when(yes("deprecated"), "anchored_deprecated").when(yes("up"), "anchored_strengthened")
        .when(yes("down"), "anchored_weakened").otherwise("anchored_persistent")
    )
    return d.select("edge_id", verdict.alias("verdict"))


def signal_outcomes(
    tracked: DataFrame,
    signals: DataFrame,
    events: DataFrame,
    triggers: DataFrame,
    edges: DataFrame,
    weight_history: DataFrame,
) -> DataFrame:
    """CAL-01: outcome of each tracked signal.

    The newest applied edge event a signal triggered decides: a deprecated edge, a
    strengthening among the edge's last five changes, a weakening among them, or
    persistence.  Other signals are clustered, isolated or unknown.  Events carry the
    verdict of their edge to the signals, so tracked rows meet others by signal only and
    those without an edge share no key.
    """
    applied = (
        events.filter(~F.col("rejected") & F.col("target_edge_id").isNotNull())
        .select("event_id", F.col("target_edge_id").alias("edge_id"), "applied_at")
        .join(edge_verdicts(edges, weight_history), "edge_id", "left")
        .select("event_id", "applied_at", F.coalesce("verdict", F.lit("anchored_persistent")).alias("verdict"))
    )
    newest = triggers.join(applied, "event_id").groupBy("signal_id").agg(
        F.max_by("verdict", F.struct("applied_at", "event_id")).alias("verdict")
    )
    stored = signals.select("signal_id", F.col("cluster_id").isNotNull().alias("clustered"))
    d = tracked.join(newest, "signal_id", "left").join(stored, "signal_id", "left")
    outcome = (
        F.when(F.col("verdict").isNotNull(), F.col("verdict"))
        .when(F.col("clustered").isNull(), "extraction_rejected")
        .when(F.col("clustered"), "clustered_but_not_anchored")
        .otherwise("isolated_in_tier_a")
    )
    return d.select(*tracked.columns, outcome.alias("resolved_outcome"))


def resolve(
    tracking: DataFrame,
    *,
    cutoff: datetime,
    batch_size: int | None = None,
    **tables: DataFrame,
) -> DataFrame:
    """CAL-02: tracking rows with pending ones before ``cutoff`` resolved and scored.

    ``batch_size`` resolves only the oldest pending rows of the run, as one call
    of the pipeline does; without it all due rows are resolved.
    """
    due = (F.col("outcome") == "pending") & (F.col("content_timestamp") < F.lit(cutoff))
    if batch_size is None:
        d = signal_outcomes(tracking, **tables).withColumn("resolved_outcome", F.when(due, F.col("resolved_outcome")))
    else:
        oldest = tracking.filter(due).orderBy("content_timestamp", "signal_id").limit(batch_size)
        done = signal_outcomes(oldest.select("run_id", "signal_id"), **tables)
        d = tracking.join(done, ["run_id", "signal_id"], "left")
    return d.select(
        "run_id", "signal_id", "source_id", "lens_id", "content_timestamp",
        F.coalesce("resolved_outcome", "outcome").alias("outcome"),
        F.coalesce(lookup(vocab.OUTCOME_SCORES, F.col("resolved_outcome")), "score").alias("score"),
    )


def checkpoint_live(
    tracking: DataFrame, *, now: datetime, observation_days: int = 90, batch_size: int | None = None,
    **tables: DataFrame,
) -> DataFrame:
    """CAL-10: resolve signals of the live run once they are ``observation_days`` old."""
    cutoff = now - timedelta(days=observation_days)
    return resolve(tracking, cutoff=cutoff, batch_size=batch_size, **tables)


def _scored(tracking: DataFrame) -> DataFrame:
    return tracking.filter(F.col("outcome") != "pending")


def group_scores(tracking: DataFrame, key: str) -> DataFrame:
    """AGG-01/02: rows and summed score per source or lens, over resolved rows.

    Scores have one decimal, so they are summed exactly as decimals.
    """
    raw = F.sum(F.col("score").cast("decimal(10,4)")).cast("double")
    return _scored(tracking).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_signals"), F.coalesce(raw, F.lit(0.0)).alias("raw_score")
    ).withColumn("mean_score", F.col("raw_score") / F.col("n_signals"))


def outcome_breakdown(tracking: DataFrame, key: str) -> DataFrame:
    """AGG-03: resolved rows per key and outcome."""
    return _scored(tracking).groupBy(key, "outcome").agg(F.count(F.lit(1)).alias("n"))


def breakdown_maps(tracking: DataFrame, key: str) -> DataFrame:
    """AGG-03 as one map per key; it has one entry per outcome."""
    return outcome_breakdown(tracking, key).groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("breakdown")
    )


def outcome_counts(tracking: DataFrame) -> DataFrame:
    """WIN-01: tracked rows with the number of rows of their source and outcome.

    Joined from a grouped count, so a large source is not one window partition.
    """
    n = tracking.groupBy("source_id", "outcome").agg(F.count(F.lit(1)).alias("cnt"))
    return tracking.join(n, ["source_id", "outcome"])


def new_weight(mean: Column, baseline: Column, prior: Column) -> Column:
    """CAL-04: half baseline, three tenths prior, two tenths scaled mean; four decimals."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean + 0.5) / 1.5))
    w = 0.5 * baseline + 0.3 * prior + 0.2 * scaled
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), w)), 4)


def source_scores(tracking: DataFrame, registry: DataFrame, flag_delta: float = 0.15) -> DataFrame:
    """CAL-03/05: scores, proposed weight and flag per source; unknown sources are tier 3."""
    d = group_scores(tracking, "source_id").join(
        registry.select("source_id", "tier", F.col("starting_source_weight").alias("prior_weight")),
        "source_id", "left",
    )
    d = d.withColumn("tier", F.coalesce("tier", F.lit("3"))).withColumn(
        "prior_weight", F.coalesce("prior_weight", F.lit(0.5))
    )
    d = d.withColumn(
        "tier_baseline", lookup(vocab.TIER_BASELINES, F.col("tier"), F.lit(vocab.OTHER_BASELINE))
    )
    d = d.withColumn(
        "proposed_weight",
        new_weight(F.col("mean_score"), F.col("tier_baseline"), F.col("prior_weight")),
    )
    return d.withColumn("weight_delta", F.col("proposed_weight") - F.col("prior_weight")).withColumn(
        "flagged", F.abs("weight_delta") > flag_delta
    )


def lens_scores(tracking: DataFrame, warn_below: float = -0.1) -> DataFrame:
    """CAL-05: scores and warning per lens."""
    d = group_scores(tracking, "lens_id").withColumn("flagged", F.col("mean_score") < warn_below)
    reason = F.concat(
        F.lit("mean_score "), F.format_string("%.3f", "mean_score"),
        F.lit(f" below threshold {warn_below}"),
    )
    return d.withColumn("flag_reason", F.when(F.col("flagged"), reason).otherwise(""))


def run_totals(tracking: DataFrame) -> DataFrame:
    """AGG-04/05: all, resolved and pending rows with the time span and the resolved outcomes.

    ``outcome_breakdown`` lists "outcome=rows" of each outcome that occurs, by name.
    """
    known = [o for o in sorted(vocab.OUTCOME_SCORES) if o != "pending"]
    each = [F.when(F.count_if(F.col("outcome") == o) > 0, F.concat(F.lit(f"{o}="), F.count_if(F.col("outcome") == o))) for o in known]
    return tracking.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("outcome") != "pending").alias("n_scored"),
        F.count_if(F.col("outcome") == "pending").alias("n_pending"),
        F.min("content_timestamp").alias("oldest"), F.max("content_timestamp").alias("newest"),
        F.array_join(F.array_compact(F.array(*each)), "|").alias("outcome_breakdown"),
    )


# --- leakage -----------------------------------------------------------------------

def suspicious(end_year: int) -> Column:
    """FLT-25: a later year, a tell-tale phrase, or hard data from a feed source."""
    reasoning = F.coalesce("reasoning", F.lit(""))
    text = F.concat(reasoning, F.lit(" "), F.coalesce("claim_text", F.lit("")))
    years = F.regexp_extract_all(text, F.lit(r"\b(20\d{2})\b"), 1)
    later = F.exists(years, lambda y: y.cast("int") > end_year)
    phrase = reasoning.rlike("(?i)" + "|".join(vocab.LEAK_PHRASES))
    feed = F.contains(F.lower(F.coalesce("source_id", F.lit(""))), F.lit("rss")) | (
        F.coalesce("access_method", F.lit("")) == "rss"
    )
    hard = F.coalesce(F.col("confidence_band") == "hard_datum", F.lit(False))
    return later | phrase | (hard & feed)


def sample_size(total: int, fraction: float = 0.02, low: int = 20, high: int = 200) -> int:
    """Rows to sample of ``total``."""
    return min(total, max(low, min(high, int(total * fraction))))


def leakage_sample(
    tracking: DataFrame, signals: DataFrame, registry: DataFrame, *, n: int, seed: str = "42"
) -> DataFrame:
    """CAL-06: ``n`` tracked signals in the order of a seeded digest, with their source."""
    d = tracking.select("signal_id").join(
        signals.select("signal_id", "claim_text", "reasoning", "confidence_band", "source_id"), "signal_id"
    )
    key = F.sha2(F.concat(F.col("signal_id").cast("string"), F.lit(f"|{seed}")), 256)
    d = d.withColumn("sample_key", key).orderBy("sample_key", "signal_id").limit(n)
    return d.join(registry.select("source_id", "access_method"), "source_id", "left")


def leakage(
    tracking: DataFrame, signals: DataFrame, registry: DataFrame, *, window_end: datetime,
    limit_rate: float = 0.05,
) -> DataFrame:
    """CAL-06: sampled and suspicious counts, rate and verdict."""
    n = sample_size(tracking.count())
    d = leakage_sample(tracking, signals, registry, n=n).withColumn(
        "suspicious", suspicious(window_end.year)
    )
    d = d.agg(F.count(F.lit(1)).alias("n_sampled"), F.count_if("suspicious").alias("n_suspicious"))
    rate = F.when(F.col("n_sampled") > 0, F.col("n_suspicious") / F.col("n_sampled")).otherwise(0.0)
    verdict = F.when(rate > limit_rate, "Re-run recommended.").otherwise("Within threshold.")
    return d.select(
        "n_sampled", "n_suspicious", F.round(rate, 6).alias("leakage_rate"), verdict.alias("verdict")
    )


def report(
    tracking: DataFrame, signals: DataFrame, registry: DataFrame, *, window_end: datetime
) -> DataFrame:
    """CAL-07: the whole report as one row of JSON text.

    Its arrays hold one entry per source and per lens.
    """
    def listed(scores: DataFrame, key: str, name: str) -> DataFrame:
        d = scores.join(breakdown_maps(tracking, key), key, "left")

        def best_first(a: Column, b: Column) -> Column:
            return (
                F.when(a["mean_score"] > b["mean_score"], -1).when(a["mean_score"] < b["mean_score"], 1)
                .when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0)
            )

        return d.agg(
            F.array_sort(F.collect_list(F.struct(*d.columns)), best_first).alias(name),
            F.array_sort(F.collect_list(F.when(F.col("flagged"), F.col(key)))).alias(f"flagged_{name}"),
        )

    s = listed(source_scores(tracking, registry), "source_id", "sources")
    x = listed(lens_scores(tracking), "lens_id", "lenses")
    leak = leakage(tracking, signals, registry, window_end=window_end)
    one = side_by_side(run_totals(tracking), s, x, leak)
    return one.select(F.to_json(F.struct(*one.columns)).alias("report"))


# --- weights -------------------------------------------------------------------------

def weight_versions(overrides: DataFrame) -> DataFrame:
    """SNK-08, WIN-11: override versions with the time each was superseded.

    A source has one version per calibration run, so its window is short.
    """
    w = W.partitionBy("source_id").orderBy("applied_at", "override_id")
    return overrides.withColumn("superseded_at", F.lead("applied_at").over(w))


def effective_weights(registry: DataFrame, overrides: DataFrame) -> DataFrame:
    """JOI-16, WIN-02/10: registry weight, newest override, effective weight and difference."""
    newest = overrides.groupBy("source_id").agg(
        F.max_by("weight", F.struct("applied_at", "override_id")).alias("override_weight")
    )
    d = registry.join(newest, "source_id", "left")
    return d.withColumn(
        "effective_weight", F.coalesce("override_weight", "starting_source_weight")
    ).withColumn(
        "weight_delta", F.round(F.col("effective_weight") - F.col("starting_source_weight"), 6)
    )


def override_history(overrides: DataFrame, n: int = 20) -> DataFrame:
    """WIN-10: newest ``n`` versions per source."""
    return top_per_key(
        weight_versions(overrides), ["source_id"],
        [F.col("applied_at").desc(), F.col("override_id").desc()], n,
    )


def apply_weights(
    scores: DataFrame, run_id: str, *, now: datetime, sources: list[str] | None = None
) -> DataFrame:
    """CAL-08: override rows to append for the proposed weights of a complete run."""
    d = scores if sources is None else scores.filter(F.col("source_id").isin(sources))
    return d.select(
        F.sha2(F.concat_ws("|", F.lit(run_id), "source_id"), 256).alias("override_id"),
        "source_id", F.col("proposed_weight").alias("weight"),
        F.lit(run_id).alias("calibration_run_id"), F.lit(now).alias("applied_at"),
    )


def execute_run(
    payloads: DataFrame,
    extract,
    *,
    run_id: str,
    window_start: datetime,
    window_end: datetime,
    registry: DataFrame,
    extension_days: int = 90,
    sources: list[str] | None = None,
    **tables: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """CAL-09: replay, extract, register, resolve and report.

    ``extract`` turns replayed payloads into signals.  Returns (tracking, report).
    """
    from evgraph.sources.landed import replay

    signals = extract(replay(payloads, window_start, window_end, sources))
    pending = register(None, signals, run_id)
    cutoff = window_end + timedelta(days=extension_days)
    done = resolve(pending, cutoff=cutoff, signals=signals, **tables)
    return done, report(done, signals, registry, window_end=window_end)
