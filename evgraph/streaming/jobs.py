"""Structured Streaming jobs (STR-01..07, 10).

Event times are cast to ``timestamp`` before a watermark, which refuses
timestamps without zone.  Jobs run with ``availableNow`` on a schedule or
continuously; state and progress live in the checkpoint folder of the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.operators.components import form_batches, group_signals
from evgraph.operators.ordered import latest
from evgraph.operators.quality import check_more_runs
from evgraph.session import cut_lineage


def pending_payloads(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """STR-01: hand payloads that arrived since the last run to ``work`` once each.

    The checkpoint remembers what was seen, which replaces the anti-join of the
    batch form.
    """
    accepted = stream.filter(~F.col("rejected"))
    return (
        accepted.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(work).start()
    )


def check_stream(stream: DataFrame, home: str, *, run: Column, run_start: Column, days: int = 7) -> DataFrame:
    """STR-02: rows of a stream with quality flags; runs arrive in order, each in any number of batches.

    The rule is the one of :func:`check_runs`.  Between micro-batches one narrow row per
    source, content and run of the last ``days`` is kept, under the number of the batch,
    so a batch that is repeated after a failure reads and writes the same.  Repeats are
    flagged, not dropped.
    """
    def work(batch: DataFrame, number: int) -> None:
        read = batch.sparkSession.read
        before = read.parquet(f"{home}/memory/{number - 1}") if number else None
        flagged, memory = check_more_runs(
            batch, run=run, run_start=run_start, days=days, memory=before, remember=True)
        memory.write.mode("overwrite").parquet(f"{home}/memory/{number}")
        flagged.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")

    (
        stream.writeStream.option("checkpointLocation", f"{home}/progress")
        .trigger(availableNow=True).foreachBatch(work).start().awaitTermination()
    )
    return stream.sparkSession.read.parquet(f"{home}/rows/batch=*")


def split_late(batch: DataFrame, watermark) -> tuple[DataFrame, DataFrame]:
    """STR-03: (on time, late) rows of a micro-batch by content time.

    Late rows go to a side table; the batch fold repairs the windows they belong to.
    """
    late = F.col("content_timestamp") < F.lit(watermark)
    return batch.filter(~late), batch.filter(late)


def weekly_counts(stream: DataFrame, time: str, keys: list[str], delay: str = "7 days") -> DataFrame:
    """STR-05: tumbling Monday weeks.  Windows count from a Thursday, hence the start of 4 days."""
    d = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return d.groupBy(F.window(time, "7 days", startTime="4 days"), *keys).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("window.start").alias("week_start"), *keys, "n")


def count_hours(stream: DataFrame, time: str, home: str, keys: list[str] | None = None, delay: str = "1 day") -> DataFrame:
    """STR-03/06: hourly counts of a stream in one pass, late rows apart: keys, hour, late, n.

    A row is late if it is older than the newest time of earlier micro-batches less ``delay``.  Counts
    add up, so a micro-batch writes what it counted under its number and reads one row, the newest
    time so far; a repeated batch writes the same.  Late rows themselves go to ``late`` below ``home``.
    Any look-back is a sum of hours (:func:`look_back`), and a late row repairs the hours it belongs to.
    """
    keys = keys or []

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn(time, F.col(time).cast("timestamp"))
        before = spark.read.parquet(f"{home}/clock/{number - 1}").first()[0] if number else None
        mark = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        flagged = batch.withColumn("late", F.coalesce(F.col(time) < mark, F.lit(False)))
        # Rows are read once for the counts and the newest time, and again only if some are late.
        hours = cut_lineage(flagged.groupBy(*keys, F.date_trunc("hour", time).alias("hour"), "late").agg(
            F.count(F.lit(1)).alias("n"), F.max(time).alias("newest")))
        newest, some_late = hours.agg(F.max("newest"), F.bool_or("late")).first()
        clock = max([t for t in (before, newest) if t is not None], default=None)
        late = flagged.filter("late") if some_late else flagged.limit(0)
        late.drop("late").write.mode("overwrite").parquet(f"{home}/late/batch={number}")
        hours.drop("newest").write.mode("overwrite").parquet(f"{home}/hours/batch={number}")
        spark.range(1).select(F.lit(clock).cast("timestamp").alias("clock")).write.mode("overwrite").parquet(f"{home}/clock/{number}")

    (
        stream.writeStream.option("checkpointLocation", f"{home}/progress")
        .trigger(availableNow=True).foreachBatch(work).start().awaitTermination()
    )
    counts = stream.sparkSession.read.parquet(f"{home}/hours/batch=*")
    return counts.groupBy(*keys, "hour", "late").agg(F.sum("n").alias("n"))


def look_back(hours: DataFrame, length: int, keys: list[str] | None = None) -> DataFrame:
    """STR-06: as_of, n: rows of the ``length`` hours before each full hour, from hourly counts."""
    keys = keys or []
    moved = hours.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(length))).alias("k"), "hour", "n")
    as_of = F.col("hour") + F.make_interval(hours=F.col("k"))
    return moved.groupBy(*keys, as_of.alias("as_of")).agg(F.sum("n").alias("n"))


def idle_sessions(stream: DataFrame, time: str, key: str, gap: str = "48 hours",
                  delay: str = "48 hours") -> DataFrame:
    """STR-07: sessions that end after ``gap`` without activity."""
    d = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return d.groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("session_window.start").alias("started_at"),
        F.col("session_window.end").alias("expires_at"), "n",
    )


def running_sessions(closed: DataFrame, key: str, checkpoint: str) -> DataFrame:
    """STR-07: sessions still open, with the columns of ``closed``, read from the state of the query.

    Append mode gives a session once, when the watermark has passed its end.  Until then it is a row of
    the state store in the checkpoint folder of the query; after each micro-batch every session is
    in exactly one of the two.
    """
    state = closed.sparkSession.read.format("statestore").load(checkpoint).select("value.*")
    return state.select(
        key, F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("expires_at"),
        F.col("count").alias("n"),
    )


def run_to_table(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", keys: list[str] | None = None
) -> DataFrame:
    """Run an aggregate over all available input and read the result back.

    ``append`` adds final rows; ``update`` adds the changed rows of a micro-batch, of
    which the newest per ``keys`` is read.  A batch is written under its number, so a
    repeated batch overwrites itself, and nothing is written twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    rows = stream.sparkSession.read
    if mode == "append":
        return rows.schema(stream.schema).parquet(f"{path}/batch=*")
    return latest(rows.option("basePath", path).parquet(f"{path}/batch=*"), keys, ["batch"]).drop("batch")


def fold_stream(events: DataFrame, fold: Callable[[DataFrame | None, DataFrame], DataFrame], touched: Callable[[DataFrame], DataFrame],
                keys: list[str], home: str, compact_every: int = 16) -> DataFrame:
    """STR-10: append mutation events to a log and fold them into a keyed state, which is returned.

    ``fold`` takes stored rows (``None`` at first) and the events of a micro-batch; ``touched`` gives the
    ``keys`` that events may change.  Only the stored rows of those keys are folded, and a micro-batch writes
    the rows that came out different, so its work and its bytes follow its events, not the state.
    Every ``compact_every``-th batch writes the state as a whole, so a reader takes one base and fewer
    deltas than that.  All goes under the batch number and reads smaller numbers only; a batch repeated
    after a failure leaves the same files.
    """
    spark = events.sparkSession

    def work(batch: DataFrame, number: int) -> None:
        folder = f"{home}/log/batch={number}"
        batch.write.mode("overwrite").parquet(folder)
        new = batch.sparkSession.read.schema(batch.schema).parquet(folder)
        before = folded_state(batch.sparkSession, home, keys, number - 1, compact_every) if number else None
        if before is not None:
            before = cut_lineage(before.join(touched(new).select(*keys).distinct(), keys, "left_semi"))
        after = fold(before, new)
        if before is not None:
            after = _different(after, before, keys)
        after.write.mode("overwrite").parquet(f"{home}/delta/version={number}")
        if number % compact_every == compact_every - 1:
            whole = folded_state(batch.sparkSession, home, keys, number, compact_every, based=False)
            whole.write.mode("overwrite").parquet(f"{home}/base/version={number}")

    (
        events.writeStream.option("checkpointLocation", f"{home}/progress")
        .trigger(availableNow=True).foreachBatch(work).start().awaitTermination()
    )
    last = spark.read.option("basePath", f"{home}/log").parquet(f"{home}/log/batch=*").agg(F.max("batch")).first()[0]
    return folded_state(spark, home, keys, last, compact_every)


def _different(after: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``after`` that ``before`` does not hold just so; maps are compared by their entries."""
    plain = lambda d: F.to_json(F.struct(*[
        F.array_sort(F.map_entries(f.name)).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name)
        for f in d.schema.fields if f.name in after.columns]))
    old = before.select(*after.columns).select(*keys, plain(before).alias("__old"))
    return after.withColumn("__new", plain(after)).join(old, keys, "left").filter(
        ~F.col("__new").eqNullSafe(F.col("__old"))).drop("__new", "__old")


def folded_state(spark: SparkSession, home: str, keys: list[str], number: int, compact_every: int = 16, based: bool = True) -> DataFrame:
    """State after micro-batch ``number``: the newest base up to it and the deltas since, newest row per key.

    With ``based=False`` the base that ``number`` itself writes is not read yet.
    """
    base = (number + 1) // compact_every * compact_every - 1
    if base == number and not based:
        base -= compact_every
    paths = [(f"{home}/base/version={base}", base)] if base >= 0 else []
    paths += [(f"{home}/delta/version={k}", k) for k in range(max(base, -1) + 1, number + 1)]
    rows = None
    for path, version in paths:
        part = spark.read.parquet(path).withColumn("__version", F.lit(version))
        rows = part if rows is None else rows.unionByName(part)
    return rows.drop("__version") if len(paths) == 1 else latest(rows, keys, ["__version"]).drop("__version")


def hold_back(signals: DataFrame, home: str, *, hold_hours: float = 6.0, minimum: int = 2) -> DataFrame:
    """STR-04: release signals in batches once their group is large enough or overdue.

    ``signals`` streams signal_id, names (array), content_timestamp and extracted_at.
    The signals that wait are a small table under the number of the micro-batch.  They
    and the new ones are grouped by shared names, transitively, and cut into batches as
    in the batch form; the clock is the newest extraction time so far.  A signal leaves
    once, and a later single signal of its group waits again.
    """
    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = batch.columns
        pool = batch if not number else batch.unionByName(spark.read.parquet(f"{home}/waiting/{number - 1}"))
        pool = cut_lineage(pool)
        clock = pool.agg(F.max("extracted_at")).first()[0]
        if number:
            before = spark.read.parquet(f"{home}/clock/{number - 1}").first()[0]
            clock = max(t for t in (clock, before) if t is not None)
        names = pool.select("signal_id", F.explode("names").alias("name"))
        out = cut_lineage(form_batches(
            group_signals(pool, names), now=clock, minimum=minimum, max_hold_hours=hold_hours))
        waiting = pool.join(out.select("signal_id"), "signal_id", "left_anti").select(*columns)
        out.write.mode("overwrite").parquet(f"{home}/rows/batch={number}")
        waiting.write.mode("overwrite").parquet(f"{home}/waiting/{number}")
        spark.range(1).select(F.lit(clock).alias("clock")).write.mode("overwrite").parquet(f"{home}/clock/{number}")

    (
        signals.writeStream.option("checkpointLocation", f"{home}/progress")
        .trigger(availableNow=True).foreachBatch(work).start().awaitTermination()
    )
    return signals.sparkSession.read.option("basePath", f"{home}/rows").parquet(f"{home}/rows/batch=*")
