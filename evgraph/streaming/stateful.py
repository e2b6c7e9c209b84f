"""Streaming operators with their own state (STR-08)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


class Quota(StatefulProcessor):
    """Accepted request times of the last window per key, at most ``limit`` of them."""

    def __init__(self, limit: int, window_seconds: int) -> None:
        self.limit, self.window = limit, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", "us array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = list(self.times.get()[0]) if self.times.exists() else []
        pdf = pd.concat(list(rows)).sort_values(["us", "request_id"])
        allowed = []
        for us in pdf["us"]:
            times = [t for t in times if t >= us - self.window]
            ok = len(times) < self.limit
            allowed.append(ok)
            if ok:
                times.append(int(us))
        self.times.update((times,))
        yield pd.DataFrame({"key_id": key[0], "request_id": pdf["request_id"].to_numpy(),
                            "allowed": allowed})

    def close(self) -> None:
        pass


def stream_quota(requests: DataFrame, *, limit: int = 10, window_seconds: int = 60) -> DataFrame:
    """STR-08 as a stream: ``requests`` streams key_id, request_id (long) and us (micros)."""
    return requests.groupBy("key_id").transformWithStateInPandas(
        Quota(limit, window_seconds), "key_id long, request_id long, allowed boolean",
        outputMode="append", timeMode="none",
    )
