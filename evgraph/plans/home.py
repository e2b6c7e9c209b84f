"""Home view: dimension scores, ranked changes and cached notes (CHG-05)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.plans.changes import recent_changes
from evgraph.plans.dimensions import dimension_scores


def home_view(
    nodes: DataFrame,
    edges: DataFrame,
    weight_history: DataFrame,
    state_history: DataFrame,
    topic_nodes: DataFrame,
    notes: DataFrame,
    *,
    now: datetime,
    as_of: datetime | None = None,
) -> tuple[DataFrame, DataFrame]:
    """CHG-05: (dimensions with notes, twelve changes of 24 hours).

    Notes describe the present, so a past view carries none.
    """
    at = as_of or now
    scores = dimension_scores(nodes, edges, state_history, as_of=at)
    if as_of is None:
        scores = scores.join(notes.select("dimension", "note"), "dimension", "left")
    else:
        scores = scores.withColumn("note", F.lit(""))
    scores = scores.fillna("", ["note"])
    return scores, recent_changes(
        nodes, edges, weight_history, state_history, topic_nodes, as_of=at, limit=12
    )


def change_log(*tables: DataFrame, as_of: datetime, hours: int = 24, limit: int = 20) -> DataFrame:
    """CHG-05: change list with a chosen window (1 to 720 hours) and length (1 to 100)."""
    if not 1 <= hours <= 720:
        raise ValueError("hours must be between 1 and 720")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return recent_changes(*tables, as_of=as_of, hours=hours, limit=limit)
