"""Ingestion cycle: fetch rows to stored and archived payloads (ING-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.operators.quality import check_run, normalise
from evgraph.plans.health import stored_per_source
from evgraph.session import cut_lineage
from evgraph.sources import sinks


def ingest(fetched: DataFrame, stored: DataFrame | None, *, now) -> DataFrame:
    """Quality flags and payload columns of one run's fetch rows, nothing written.

    Rows keep the order of arrival given by ``arrival``; without it the fetch time
    and url decide.
    """
    d = fetched if "arrival" in fetched.columns else fetched.withColumn(
        "arrival", F.xxhash64("url", "content")
    )
    return normalise(check_run(d, stored, now=now)).drop("arrival", "content_hash")


def run_all(
    fetched: DataFrame, stored: DataFrame | None, *, now, store: str, archive: str
) -> DataFrame:
    """ING-01: store every payload, archive the accepted ones, count them per source."""
    payloads = cut_lineage(ingest(fetched, stored, now=now))
    sinks.write_payloads(payloads, store)
    sinks.archive_payloads(payloads, archive)
    return stored_per_source(payloads)
