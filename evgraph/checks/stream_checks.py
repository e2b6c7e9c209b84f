"""Queries that run as Structured Streaming jobs over the given events and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.checks.graph_checks import graph_events
from evgraph.checks.ingest_checks import CHECKED
from evgraph.checks.registry import SQL, query
from evgraph.checks.tables import duck
from evgraph.session import cut_lineage, ensure_checkpoint_dir
from evgraph.operators import mutate
from evgraph.streaming import jobs


def stream(t, name: str) -> DataFrame:
    """A given table as a file stream; timestamps without zone become UTC timestamps.

    A table is one file or a folder of part files.  The pattern fits both: a stream lists what lies
    in a folder and takes a single file by a pattern only.
    """
    schema = t.spark.read.parquet(f"{t.folder}/{name}.parquet").schema
    d = t.spark.readStream.schema(schema).parquet(f"{t.folder}/{name}.parque[t]")
    for f in schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            d = d.withColumn(f.name, d[f.name].cast("timestamp"))
    return d


def home(t) -> str:
    """A new folder below the session's checkpoint folder."""
    return f"{ensure_checkpoint_dir(t.spark)}/streams/{uuid.uuid4().hex}"


def finish(t, d: DataFrame, keys: list[str]) -> DataFrame:
    """Run over all input; table and progress go below the session's checkpoint folder."""
    at = home(t)
    return jobs.run_to_table(d, f"{at}/table", f"{at}/progress", "update", keys)


#: Rows of a micro-batch that one task writes into a file.
FILE_ROWS = 20_000


def in_files(t, d: DataFrame, time: str | Column, parts: int, span: int = 31) -> DataFrame:
    """``d`` as a stream of several micro-batches, by day of month of ``time`` or a number from 1 to ``span``.

    Every micro-batch has the same number of files, which grows with the rows, so no task holds a whole one.
    Rows are dealt over just as many tasks.  Where rows are fewer than files empty ones follow, each by a job of its
    own, for the source counts files.
    """
    at = f"{home(t)}/input"
    d = d.withColumn("__day", F.dayofmonth(time) if isinstance(time, str) else time)
    bounds = [(span * k // parts, span * (k + 1) // parts) for k in range(parts)]
    within = [(F.col("__day") > low) & (F.col("__day") <= high) for low, high in bounds]
    most = max(d.agg(*[F.count_if(w).alias(f"n{k}") for k, w in enumerate(within)]).first())
    files = max(1, -(-most // FILE_ROWS))
    schema = d.drop("__day").schema
    for k, w in enumerate(within):
        part = d.filter(w).drop("__day")
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(at)
        for _ in range((k + 1) * files - len(t.spark.read.schema(schema).parquet(at).inputFiles())):
            t.spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(at)
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(at)


@query("stream_weekly", """
SELECT date_trunc('week', ts)::timestamp AS week_start, event_type, count(*) AS n
FROM events GROUP BY ALL""")
def stream_weekly(t):
    return finish(t, jobs.weekly_counts(stream(t, "events"), "ts", ["event_type"]), ["week_start", "event_type"])


def delayed(t) -> DataFrame:
    """Events by day in eight micro-batches; one event in ten comes three micro-batches late."""
    e = t["events"].withColumn("__part", F.floor((F.dayofmonth("ts") - 1) / 4))
    late = F.when(F.col("event_id") % 10 == 0, F.least(F.col("__part") + 3, F.lit(7))).otherwise(F.col("__part"))
    return in_files(t, e.withColumn("__part", late), F.col("__part") + 1, 8, span=8).drop("__part")


_LATE = """
WITH e AS (SELECT *, floor((day(ts) - 1) / 4)::int AS own FROM events),
a AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN least(own + 3, 7) ELSE own END AS part FROM e),
m AS (SELECT part, max(ts) AS newest FROM a GROUP BY part),
c AS (SELECT part, max(newest) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock FROM m)
SELECT date_trunc('hour', ts)::timestamp AS hour, coalesce(ts < clock - interval '24' hour, false) AS late, count(*) AS n
FROM a JOIN c USING (part) GROUP BY ALL"""


@query("stream_late", _LATE)
def stream_late(t):
    """Counts per hour of rows on time and of late ones, which came more than a day behind the newest."""
    return jobs.count_hours(delayed(t), "ts", home(t))


def rolling(t, length: int) -> DataFrame:
    """One pass of hourly counts; late rows count in the hours they belong to."""
    return jobs.look_back(jobs.count_hours(delayed(t), "ts", home(t)), length)


_ROLLING = """
WITH e AS (SELECT date_trunc('hour', ts) AS h FROM events)
SELECT h + to_hours(k) AS as_of, count(*) AS n
FROM e CROSS JOIN (SELECT unnest(range(1, {end})) AS k) r GROUP BY 1"""


@query("stream_rolling", _ROLLING.format(end=25))
def stream_rolling(t):
    return rolling(t, 24)


@query("stream_rolling_4h", _ROLLING.format(end=5))
def stream_rolling_4h(t):
    return rolling(t, 4)


@query("stream_rolling_1h", _ROLLING.format(end=2))
def stream_rolling_1h(t):
    return rolling(t, 1)


@query("stream_sessions", """
WITH l AS (SELECT *, coalesce(ts >= lag(ts) OVER w + interval '30' minute, true) AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
, r AS (SELECT *, sum(fresh::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l)
SELECT user_id, min(ts) AS started_at, max(ts) + interval '30' minute AS expires_at, count(*) AS n
FROM r GROUP BY user_id, run""")
def stream_sessions(t):
    """Four micro-batches; sessions that the watermark closed, and those still open in the state."""
    events = in_files(t, t["events"], "ts", 4)
    at = home(t)
    closed = jobs.run_to_table(jobs.idle_sessions(events, "ts", "user_id", gap="30 minutes"), f"{at}/table", f"{at}/progress", "append")
    return closed.unionByName(jobs.running_sessions(closed, "user_id", f"{at}/progress"))


@query("stream_known_content", duck(CHECKED + """
SELECT payload_id, source_id, content_hash, rejected_reason IS NOT NULL AS rejected,
  rejected_reason FROM checked""", "payloads"))
def stream_known_content(t):
    """Four micro-batches of a week; the memory of one reaches into the next."""
    p = t["payloads"].withColumn("arrival", F.col("payload_id"))
    rows = jobs.check_stream(
        in_files(t, p, "fetched_at", 4), home(t), run=F.to_date("fetched_at"), run_start=F.date_trunc("day", "fetched_at"))
    return rows.select("payload_id", "source_id", "content_hash", "rejected", "rejected_reason")


@query("stream_dedup", duck("""
SELECT source_id, count(DISTINCT sha256(content)) AS n_contents FROM payloads GROUP BY source_id""",
    "payloads"))
def stream_dedup(t):
    """All documents arrive in one run: contents of a source are the rows that pass, each once, and those no rule lets pass."""
    d = stream(t, "documents").select(
        F.col("source").alias("source_id"), F.col("text").alias("content"), F.col("doc_id").alias("arrival"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )
    rows = jobs.check_stream(d, home(t), run=F.to_date("fetched_at"), run_start=F.date_trunc("day", "fetched_at"))
    unfit = F.col("rejected") & ~F.startswith("rejected_reason", F.lit("exact duplicate"))
    passed, others = F.count_if(~F.col("rejected")), F.countDistinct(F.when(unfit, F.col("content_hash")))
    return rows.groupBy("source_id").agg((passed + others).alias("n_contents"))


def folded(t, kind: str) -> DataFrame:
    """Mutation events in six micro-batches folded into stored nodes or edges.

    The events are resolved once and written; the micro-batches read those rows, so a task that writes a
    file of several partitions does not also hold the joins of all of them.
    """
    empty = getattr(mutate.empty_graph(t.spark), kind)
    fold = {"nodes": mutate.fold_nodes, "edges": mutate.fold_edges}[kind]
    key, target = {"nodes": ("node_id", "target_node"), "edges": ("edge_id", "target_edge")}[kind]
    return jobs.fold_stream(
        in_files(t, cut_lineage(graph_events(t)), "batch_time", 6), lambda held, new: fold(new, empty if held is None else held),
        lambda new: new.select(F.col(target).alias(key)).filter(F.col(key).isNotNull()), [key], home(t), compact_every=4)


@query("stream_fold_nodes", SQL["fold_nodes"])
def stream_fold_nodes(t):
    return folded(t, "nodes").select("node_id", "node_type", "name",
                                     F.try_element_at("type_data", F.lit("entity_kind")).alias("entity_kind"), "created_at")


@query("stream_fold_edges", SQL["fold_edges"])
def stream_fold_edges(t):
    return folded(t, "edges").select("edge_id", "source_node_id", "target_node_id", "edge_type", "current_weight_band")
