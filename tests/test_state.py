import os
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evgraph.operators import quality
from evgraph.plans import health, sessions
from evgraph.sources import landed, sinks
from evgraph.streaming import jobs, stateful

T = datetime(2024, 3, 1)


def land(spark, folder, name, rows, schema):
    """Writes one Parquet file into a folder that a stream watches."""
    path = f"{folder}/in"
    os.makedirs(path, exist_ok=True)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_signal_states(spark):
    s = spark.createDataFrame([(1, False), (2, False)], "signal_id long, anchored boolean")
    states = sinks.mark_anchored(s.filter("signal_id = 1"), 5).unionAll(
        sinks.assign_cluster(s.withColumn("cluster_id", F.lit("c")), 6, 0.5)).unionAll(
        sinks.assign_cluster(s.filter("signal_id = 2").withColumn("cluster_id", F.lit("d")), 7))
    got = {r["signal_id"]: (r["anchored"], r["cluster_id"], r["cluster_strength"]) for r in sinks.signal_states(s, states).collect()}
    assert got == {1: (True, "c", 0.5), 2: (False, "d", 1.0)}
    assert sinks.only_new(s.unionAll(s), s.filter("signal_id = 1"), ["signal_id"]).count() == 1
    v = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, seq int, v string")
    assert sinks.current(v, ["key"], ["seq"]).first()["v"] == "b"


def test_sessions(spark):
    m = spark.createDataFrame([(s, i, "user", T + timedelta(hours=s * 40, minutes=i)) for s in range(3) for i in range(15)],
                              "session_id int, message_no int, role string, created_at timestamp")
    assert sessions.history(m).groupBy("session_id").agg(F.max("message_no")).filter("session_id = 1").first()[1] == 11
    assert sessions.history(m, order="last").agg(F.min("message_no")).first()[0] == 3
    assert [r["message_no"] for r in sessions.full_session(m, 2).collect()] == list(range(15))
    kept, msgs = sinks.prune_sessions(sessions.sessions(m), m, now=T + timedelta(hours=80))
    assert {r["session_id"] for r in kept.collect()} == {1, 2} and msgs.count() == 30


def test_daily_cap(spark):
    d = spark.createDataFrame([(1, T, "3.00"), (2, T, "2.00"), (3, T + timedelta(hours=2), "1.00"), (4, T + timedelta(days=1), "9.00")],
                              "call_id int, ts timestamp, cost string").withColumn("cost_usd", F.col("cost").cast("decimal(18,2)"))
    assert {r["call_id"]: r["refused"] for r in sessions.daily_cap(d).collect()} == {1: False, 2: False, 3: True, 4: False}


def brute_quota(rows, limit, window):
    out, times = {}, {}
    for rid, key, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        live = [x for x in times.get(key, []) if x >= t - timedelta(seconds=window)]
        out[rid] = len(live) < limit
        times[key] = live + [t] if out[rid] else live
    return out


def quota_rows():
    import random

    rng = random.Random(4)
    return [(i, rng.choice([1, 1, 1, 2]), T + timedelta(seconds=rng.randrange(1200))) for i in range(200)]


def test_quota_equals_one_at_a_time(spark):
    rows = quota_rows()
    d = spark.createDataFrame(rows, "request_id long, key_id long, ts timestamp")
    got = sessions.quota(d, limit=3, window_seconds=60).collect()
    assert {r["request_id"]: r["allowed"] for r in got} == brute_quota(rows, 3, 60)
    assert all(1 <= r["retry_after"] <= 61 for r in got if not r["allowed"])


def test_health_reads(spark):
    runs = spark.createDataFrame([("a", T, "ok"), ("a", T - timedelta(days=1), "bad"), ("b", T - timedelta(days=9), "ok")],
                                 "job_name string, started_at timestamp, status string")
    assert [(r["job_name"], r["status"]) for r in health.last_job_runs(runs, now=T).collect()] == [("a", "ok")]
    p = spark.createDataFrame([(1, "s", T, False, "x" * 9), (2, "s", T - timedelta(hours=3), False, "y"), (3, "s", T, True, "z")],
                              "payload_id long, source_id string, fetched_at timestamp, rejected boolean, content string")
    assert [r["content_length"] for r in landed.recent_payloads(p, source_id="s").collect()] == [9, 1]
    s = spark.createDataFrame([(9,)], "payload_id long")
    assert [r["payload_id"] for r in landed.payloads_without_signals(p, s, now=T).collect()] == [1]
    with pytest.raises(ValueError):
        landed.notable_events(p, 0)


# --- streams ----------------------------------------------------------------------------

def test_pending_payloads_are_handed_over_once(spark, folder):
    schema = "payload_id long, rejected boolean"
    path = land(spark, folder, "a", [(1, False), (2, True)], schema)
    seen = []

    def run():
        s = spark.readStream.schema(schema).parquet(path)
        jobs.pending_payloads(s, lambda b, n: seen.extend(r[0] for r in b.select("payload_id").collect()), f"{folder}/cp").awaitTermination()

    run()
    land(spark, folder, "b", [(3, False)], schema)
    run()
    run()
    assert seen == [1, 3]


def test_stream_of_runs_equals_the_batch_form(spark, folder):
    schema = "arrival long, source_id string, content string, fetched_at timestamp"
    days = {"a": [0, 10], "b": [0, 3, 6, 9, 12, 15, 18, 21], "c": [0, 0], "d": [5, 12], "e": [5, 11]}
    long = "words of a content that is long enough for the first of the quality rules, which asks for eighty "
    data, n = [], 0
    for name, when in days.items():
        for d in when:
            data.append((n, "s", long + name, T + timedelta(days=d, minutes=n)))
            n += 1
    rule = {"run": F.to_date("fetched_at"), "run_start": F.date_trunc("day", "fetched_at")}
    want = {r["arrival"]: r["rejected_reason"] for r in quality.check_runs(spark.createDataFrame(data, schema), **rule).collect()}
    data.sort(key=lambda r: r[3])
    for k in range(0, len(data), 3):  # runs are cut between micro-batches too
        path = land(spark, folder, f"{k:03}", data[k : k + 3], schema)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r["arrival"]: r["rejected_reason"] for r in jobs.check_stream(s, f"{folder}/home", **rule).collect()}
    assert got == want and len(got) == n
    assert sum(v is None for v in want.values()) == 6


def test_split_late(spark):
    d = spark.createDataFrame([(1, T), (2, T - timedelta(days=9))], "id long, content_timestamp timestamp")
    ok, late = jobs.split_late(d, T - timedelta(days=7))
    assert [r["id"] for r in ok.collect()] == [1] and [r["id"] for r in late.collect()] == [2]


def test_event_log_folds_into_state(spark, folder):
    """A micro-batch writes the keys that came out different, and reads back as one fold over all events."""
    schema = "edge_id long, seq long, band string, tags map<string,string>"

    def fold(before, batch):
        rows = batch if before is None else before.unionByName(batch)
        return sinks.current(rows, ["edge_id"], ["seq"])

    data = [[(i, 1, "weak", {"a": "x", "b": str(i)}) for i in range(500)]]
    data += [[(7, 2, "strong", {}), (k, 2, "moderate", None)] for k in range(6)]
    data += [[(3, 1, "none", None), (900, 1, "weak", {"a": "x"})]]  # older than what is stored; a new one
    for k, rows in enumerate(data):
        path = land(spark, folder, f"{k:03}", rows, schema)
    written = [500, 2, 2, 2, 2, 2, 2, 1]

    def run():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        return jobs.fold_stream(s, fold, lambda new: new, ["edge_id"], f"{folder}/home", compact_every=3)

    def plain(d):
        return {(r["edge_id"], r["seq"], r["band"], str(sorted((r["tags"] or {}).items()))) for r in d.collect()}

    got = run()
    whole = sinks.current(spark.read.schema(schema).parquet(path), ["edge_id"], ["seq"])
    ties = {(7, 2)}  # written by six batches with one number
    assert {r for r in plain(got) if r[:2] not in ties} == {r for r in plain(whole) if r[:2] not in ties}
    assert got.count() == 501
    rows = spark.read.option("basePath", f"{folder}/home/delta").parquet(f"{folder}/home/delta/version=*").groupBy("version").count().collect()
    assert all(r["count"] <= written[r["version"]] for r in rows) and sum(r["count"] for r in rows) < 520
    assert sorted(os.listdir(f"{folder}/home/base")) == ["version=2", "version=5"]
    land(spark, folder, "more", [(900, 5, "strong", None)], schema)
    again = {r["edge_id"]: r["band"] for r in run().collect()}
    assert again[900] == "strong" and len(again) == 501


def test_counts_of_edges_go_on_from_stored_ones(spark):
    from evgraph.operators import mutate

    fields = {f: None for f in ("source_node_id", "target_node_id", "edge_type", "falsification_criteria")}
    stored = spark.createDataFrame(
        [("e", "a", "b", "causes", "weak", "", False, T, T, 3, 1)],
        "edge_id string, source_node_id string, target_node_id string, edge_type string, current_weight_band string, "
        "falsification_criteria string, deprecated boolean, created_at timestamp, updated_at timestamp, n_supporting long, n_disconfirming long")
    events = spark.createDataFrame(
        [("add_supporting_signal", "e", False, T, "1", 4, k) for k in range(2)],
        "event_type string, target_edge string, rejected boolean, batch_time timestamp, batch_id string, phase int, pos int"
    ).withColumns({c: F.lit(None).cast("string") for c in (*fields, "target_of_edge", "weight_band", "new_weight_band")})
    row = mutate.fold_edges(events, stored).first()
    assert (row["n_supporting"], row["n_disconfirming"]) == (5, 1)


def test_hourly_counts_repair_late_rows(spark, folder):
    schema = "id long, at timestamp"
    batches = [[0, 1, 30], [29, 5, 31], [60], [59, 10, 33]]
    for k, hours in enumerate(batches):
        path = land(spark, folder, f"{k}", [(k, T + timedelta(hours=h)) for h in hours], schema)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    hours = jobs.count_hours(s, "at", f"{folder}/home").collect()
    late = {r["hour"]: r["n"] for r in hours if r["late"]}
    assert late == {T + timedelta(hours=h): 1 for h in (5, 10, 33)}
    assert sum(r["n"] for r in hours) == 10
    assert spark.read.schema(schema).parquet(f"{folder}/home/late/batch=*").count() == 3
    rolled = {r["as_of"]: r["n"] for r in jobs.look_back(jobs.count_hours(s, "at", f"{folder}/home"), 4).collect()}
    assert rolled[T + timedelta(hours=33)] == 3 and rolled[T + timedelta(hours=2)] == 2


def test_sessions_are_closed_or_running(spark, folder):
    schema = "user long, at timestamp"
    batches = [[(1, 0), (2, 0)], [(1, 20), (2, 200)], [(3, 9_000), (1, 9_010)]]
    for k, rows in enumerate(batches):
        path = land(spark, folder, f"{k}", [(u, T + timedelta(minutes=m)) for u, m in rows], schema)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    closed = jobs.run_to_table(jobs.idle_sessions(s, "at", "user", "30 minutes"), f"{folder}/table", f"{folder}/progress", "append")
    open_ = jobs.running_sessions(closed, "user", f"{folder}/progress")
    plain = lambda d: {(r["user"], r["started_at"], r["n"]) for r in d.collect()}
    assert plain(closed) == {(1, T, 2), (2, T, 1), (2, T + timedelta(minutes=200), 1)}
    assert plain(open_) == {(3, T + timedelta(minutes=9_000), 1), (1, T + timedelta(minutes=9_010), 1)}


def _collect(query_input, folder, mode="append"):
    rows = []

    def keep(batch, _):
        rows.extend(tuple(r) for r in batch.collect())

    q = (query_input.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/cp")
         .trigger(availableNow=True).foreachBatch(keep).start())
    q.awaitTermination()
    return rows


def test_small_groups_are_held_back(spark, folder):
    schema = "signal_id long, names array<string>, content_timestamp timestamp, extracted_at timestamp"

    def run(tag, rows):
        path = land(spark, folder, tag, [(i, n, T, T + timedelta(hours=h)) for i, n, h in rows], schema)
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        out = jobs.hold_back(s, f"{folder}/home")
        return {(r["signal_id"], r["group_id"]) for r in out.collect()}

    # Output folders of the batches exist from the first one on.
    first = run("a", [(1, ["oil"], 0), (2, ["gas"], 0), (9, ["x", "y"], 0), (10, ["y", "z"], 0), (11, ["z"], 0)])
    assert first == {(9, 9), (10, 9), (11, 9)}  # joined through shared names
    second = run("b", [(3, ["oil", "wells"], 1)])
    assert second - first == {(1, 1), (3, 1)}  # two names, released once
    third = run("c", [(4, ["oil"], 2)])
    assert third == second  # a later single signal waits again
    fourth = run("d", [(5, ["tin"], 9)])
    assert fourth - third == {(2, 2), (4, 4)}  # both overdue, tin waits


def test_stream_quota_equals_one_at_a_time(spark, folder):
    rows = sorted(quota_rows(), key=lambda r: r[2])
    schema = "request_id long, key_id long, us long"
    data = [(i, k, int(pd.Timestamp(t).value // 1000)) for i, k, t in rows]
    path = land(spark, folder, "a", data[:90], schema)
    got = []

    def run():
        s = spark.readStream.schema(schema).parquet(path)
        got.extend(_collect(stateful.stream_quota(s, limit=3), folder))

    run()
    land(spark, folder, "b", data[90:], schema)
    run()
    assert {r[1]: r[2] for r in got} == brute_quota(rows, 3, 60)
