"""Scenario store and projection cycle (SNK-09, FLT-29, PRO-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.plans.extract import parse_scenarios


def with_deprecation(scenarios: DataFrame) -> DataFrame:
    """SNK-09: scenarios with a ``deprecated`` flag.

    Each row carries ``save_no``, which grows with every save, and ``replaces``
    (the save marked earlier ones deprecated).  A row is deprecated when a later
    save of the same dimension replaced; a null dimension is one of its own.
    """
    last = scenarios.groupBy("dimension").agg(
        F.max(F.when(F.col("replaces"), F.col("save_no"))).alias("__last")
    )
    a, b = scenarios.alias("a"), last.alias("b")
    d = a.join(b, F.col("a.dimension").eqNullSafe(F.col("b.dimension")), "left").select("a.*", "b.__last")
    return d.withColumn(
        "deprecated", F.coalesce(F.col("save_no") < F.col("__last"), F.lit(False))
    ).drop("__last")


def read_scenarios(
    scenarios: DataFrame, *, as_of, dimension: str | None = None, limit: int | None = None,
    include_deprecated: bool = False,
) -> DataFrame:
    """FLT-29: newest scenarios generated by ``as_of``, bands in text order."""
    d = scenarios.filter(F.col("generated_at") <= F.lit(as_of))
    d = d if include_deprecated else d.filter(~F.col("deprecated"))
    d = d if dimension is None else d.filter(F.col("dimension") == dimension)
    order = [F.col("generated_at").desc(), "probability_band", "scenario_id"]
    return d if limit is None else d.orderBy(*order).limit(limit)


def projection_cycle(responses: DataFrame, stored: DataFrame | None, *, save_no: int) -> DataFrame:
    """PRO-01: scenario rows to append for all dimensions at once.

    An unknown dimension is an error.  A response without valid scenarios saves
    nothing for its dimension, and so deprecates nothing there.
    """
    strange = responses.filter(
        F.col("dimension").isNotNull() & ~F.col("dimension").isin(vocab.DIMENSIONS)
    ).select("dimension").head()
    if strange is not None:
        raise ValueError(f"unknown dimension: {strange[0]}")
    rows = parse_scenarios(responses).withColumn("save_no", F.lit(save_no)).withColumn(
        "replaces", F.lit(True)
    )
    if stored is None:
        return rows
    return rows.join(stored.select("scenario_id"), "scenario_id", "left_anti")
