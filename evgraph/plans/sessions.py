"""Conversation sessions, request quota and spend cap (WIN-08/09, STR-08/09)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.operators.ordered import previous_value, running_total, top_per_key


def history(messages: DataFrame, n: int = 12, order: str = "first") -> DataFrame:
    """WIN-08: the first ``n`` messages per session, or the last ones."""
    cols = [F.col("created_at"), F.col("message_no")]
    return top_per_key(
        messages, ["session_id"], cols if order == "first" else [c.desc() for c in cols], n
    )


def sessions(messages: DataFrame) -> DataFrame:
    """WIN-09: message count and time span per session; messages stay rows ordered by time."""
    return messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.min("created_at").alias("started_at"),
        F.max("created_at").alias("last_active"),
    )


def full_session(messages: DataFrame, session_id) -> DataFrame:
    """WIN-09: ordered messages of one session."""
    return messages.filter(F.col("session_id") == session_id).orderBy("created_at", "message_no")


def daily_cap(costs: DataFrame, cap: str = "5.00") -> DataFrame:
    """STR-09: calls with the spend before them that day; refused once it reaches the cap.

    A refused call adds nothing, but once the cap is reached it stays reached, so
    the sum over all earlier calls refuses the same ones.  Running sums are split
    by minute, so a day is not one task.
    """
    d = costs.withColumn("day", F.to_date("ts"))
    d = running_total(d, ["day"], ["ts", "call_id"], F.date_trunc("minute", "ts"), "cost_usd", "__run")
    d = d.withColumn("spent_before", F.col("__run") - F.col("cost_usd")).drop("__run")
    return d.withColumn("refused", F.col("spent_before") >= F.lit(cap).cast("decimal(18,6)"))


def quota(requests: DataFrame, *, limit: int = 10, window_seconds: int = 60) -> DataFrame:
    """STR-08: at most ``limit`` accepted requests per key in any window; denied ones do not count.

    ``requests`` holds request_id, key_id and ts.  A gap longer than the window
    forgets everything, so a key is cut into independent runs at such gaps and
    runs spread over tasks.  Inside a task rows stream through in time order with
    a memory of ``limit`` times; no run is gathered.
    """
    d = previous_value(
        requests.select("request_id", "key_id", "ts"), ["key_id"], ["ts", "request_id"],
        F.date_trunc("hour", "ts"), "ts", "__prev",
    )
    gap = F.unix_micros("ts") - F.unix_micros("__prev")
    cut = F.coalesce(gap > F.lit(window_seconds * 1_000_000), F.lit(True)).cast("int")
    d = running_total(
        d.withColumn("__cut", cut), ["key_id"], ["ts", "request_id"], F.date_trunc("hour", "ts"),
        "__cut", "__run",
    )
    d = (
        d.withColumn("us", F.unix_micros("ts")).select("request_id", "key_id", "us", "__run")
        .repartition("key_id", "__run").sortWithinPartitions("key_id", "__run", "us", "request_id")
    )
    window = window_seconds * 1_000_000

    def admit(batches: Iterator) -> Iterator:
        current, times = None, deque()
        for pdf in batches:
            allowed, retry = [], []
            for key, run, us in zip(pdf["key_id"], pdf["__run"], pdf["us"]):
                if (key, run) != current:
                    current, times = (key, run), deque()
                while times and times[0] < us - window:
                    times.popleft()
                ok = len(times) < limit
                allowed.append(ok)
                retry.append(0 if ok else (window - (us - times[0])) // 1_000_000 + 1)
                if ok:
                    times.append(us)
            out = pdf[["request_id", "key_id"]].copy()
            out["allowed"], out["retry_after"] = allowed, retry
            yield out

    kinds = dict(requests.dtypes)
    schema = (
        f"request_id {kinds['request_id']}, key_id {kinds['key_id']}, allowed boolean, retry_after bigint"
    )
    return d.mapInPandas(admit, schema)
