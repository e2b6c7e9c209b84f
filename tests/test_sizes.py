"""Tables of other shapes and sizes than the smallest ones."""

import json
import random
import re
import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from evgraph.checks import stream_checks
from evgraph.checks.registry import QUERIES
from evgraph.checks.tables import Tables
from evgraph.operators import components, mutate, quality, similarity, traverse, vectors
from evgraph.plans import anchoring, calibrate, changes, extract, review, topics
from evgraph.session import configure
from evgraph.streaming import jobs


def test_streamed_table_may_be_a_folder_of_files(spark, folder):
    d = spark.range(30).selectExpr(
        "id AS doc_id", "concat('src', id % 2) AS source", "concat('a longer text of some words, number ', id % 7) AS text")
    d.repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = {r["source_id"]: r["n_contents"] for r in QUERIES["stream_dedup"](spark, folder).collect()}
    assert got == {"src0": 7, "src1": 7}


def _brute_near(edges, signals, above, k):
    def grams(x):
        return {("  " + w + " ")[i:i + 3] for w in re.findall(r"[^\W_]+", x.lower()) for i in range(len(w) + 1)}

    out = set()
    for edge, *ends in edges:
        hits = set()
        for name in ends:
            a = grams(name)
            for no, claim, at in signals:
                b = grams(claim)
                if a & b and len(a & b) / len(a | b) > above:
                    hits.add((at, no))
        out |= {(edge, no) for _, no in sorted(hits)[::-1][:k]}
    return out


def test_newest_near_signals_equal_brute_force_over_many_slabs(spark, monkeypatch):
    """Names that almost every claim resembles, names with few matches and names with none."""
    monkeypatch.setattr(similarity, "SLABS", (4, 12, 30))
    rng = random.Random(5)
    words = ["steel", "ring", "copper", "bolt", "large", "small", "hot", "cold"]
    start = datetime(2024, 1, 1)
    signals = [(n, f"supplier {rng.randrange(12)} ships {rng.choice(words)} {rng.choice(words)}" if n % 5 else f"{rng.choice(words)} x",
                start + timedelta(hours=rng.randrange(40))) for n in range(120)]
    edges = [(n, f"supplier {n % 12}", f"{rng.choice(words)} {rng.choice(words)}" if n % 9 else "zzz qqq") for n in range(40)]
    got = similarity.signals_near_edges(
        spark.createDataFrame(edges, "edge_id long, source_name string, target_name string"),
        spark.createDataFrame(signals, "signal_id long, claim_text string, content_timestamp timestamp"), above=0.15, k=7)
    assert {(r["edge_id"], r["signal_id"]) for r in got.collect()} == _brute_near(edges, signals, 0.15, 7)


def test_finished_names_meet_no_older_claims(spark, monkeypatch):
    """Every name resembles every claim: pairs are as many as the newest slab makes, not names times claims."""
    met = []
    real = similarity._near_pairs
    monkeypatch.setattr(similarity, "SLABS", (10, 20, 40))
    monkeypatch.setattr(similarity, "_near_pairs", lambda *a: met.append((d := real(*a)).count()) or d)
    edges = spark.range(50).selectExpr("id AS edge_id", "concat('supplier ', id) AS source_name", "'none' AS target_name")
    signals = spark.range(400).selectExpr(
        "id AS signal_id", "concat('supplier ships ', id) AS claim_text", "timestamp '2024-01-01' + id * interval '1' hour AS content_timestamp")
    assert similarity.signals_near_edges(edges, signals, k=5).count() == 250
    assert sum(met) <= 50 * 10


def test_batches_with_the_same_roots_share_their_context(spark, monkeypatch):
    packed = []
    real = anchoring._pack
    monkeypatch.setattr(anchoring, "_pack", lambda rows, *a, **b: packed.append(rows.count()) or real(rows, *a, **b))
    nodes = spark.range(12).selectExpr("concat('n', id) AS node_id", "'entity' AS node_type", "concat('oil field ', id) AS name", "'' AS description")
    edges = spark.range(11).selectExpr(
        "concat('e', id) AS edge_id", "concat('n', id) AS source_node_id", "concat('n', id + 1) AS target_node_id", "'causes' AS edge_type",
        "'weak' AS current_weight_band", "false AS deprecated", "'' AS falsification_criteria")
    names = spark.range(40).selectExpr("id AS batch_id", "0 AS name_no", "concat('oil field ', id % 2) AS name")
    rows = anchoring.batch_context(names, nodes, edges).collect()
    of = {b: {(r["section"], r["item"], r["line"], r["used"]) for r in rows if r["batch_id"] == b} for b in range(40)}
    assert of[0] and all(of[b] == of[b % 2] for b in of)
    assert max(packed) <= 2 * 12


def test_micro_batches_span_files_and_stay_apart(spark, folder, monkeypatch):
    """Parts of 40, 0, 7 and 33 rows: a batch each, none in one file where it is too large for a task."""
    monkeypatch.setattr(stream_checks, "FILE_ROWS", 10)
    d = spark.range(80).selectExpr("id", "CASE WHEN id < 40 THEN 1 WHEN id < 47 THEN 3 ELSE 4 END AS part").repartition(8)
    stream = stream_checks.in_files(Tables(spark, folder), d, F.col("part"), 4, span=4)
    seen = {}
    stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(
        lambda rows, k: seen.update({k: (rows.count(), rows.select(F.input_file_name()).distinct().count(), {r["part"] for r in rows.collect()})})).start().awaitTermination()
    assert [seen[k][0] for k in sorted(seen)] == [40, 0, 7, 33]
    assert [seen[k][2] for k in sorted(seen)] == [{1}, set(), {3}, {4}]
    assert seen[0][1] == 4


def test_rows_of_one_task_are_dealt_over_the_files_of_a_micro_batch(spark, folder, monkeypatch):
    """Files with rows are as many as the rows ask for, so no empty one has to be written by a job of its own."""
    monkeypatch.setattr(stream_checks, "FILE_ROWS", 10)
    d = spark.range(80).selectExpr("id", "1 + id % 2 AS part").coalesce(1)
    stream = stream_checks.in_files(Tables(spark, folder), d, F.col("part"), 2, span=2)
    seen = {}
    stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(
        lambda rows, k: seen.update({k: (rows.count(), rows.select(F.input_file_name()).distinct().count())})).start().awaitTermination()
    assert seen == {0: (40, 4), 1: (40, 4)}


def test_state_of_streams_is_kept_off_the_heap(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    configure(other)
    assert other.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
    assert other.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"


def test_hours_and_newest_time_are_read_in_one_pass(spark, folder, monkeypatch):
    """Four micro-batches, the last one late: rows are read for the counts, and once more where some are late."""
    passes = []
    real = jobs.cut_lineage
    monkeypatch.setattr(jobs, "cut_lineage", lambda d: passes.append(d.columns) or real(d))
    d = spark.range(40).selectExpr("timestamp '2024-01-10' - CASE WHEN id < 30 THEN 0 ELSE 5 END * interval '1' day AS ts", "1 + floor(id / 10) AS part")
    stream = stream_checks.in_files(Tables(spark, folder), d, F.col("part"), 4, span=4)
    got = {(str(r["hour"]), r["late"]): r["n"] for r in jobs.count_hours(stream, "ts", f"{folder}/home").collect()}
    assert got == {("2024-01-10 00:00:00", False): 30, ("2024-01-05 00:00:00", True): 10}
    assert passes == [["hour", "late", "n", "newest"]] * 4
    assert spark.read.parquet(f"{folder}/home/late/batch=*").count() == 10


def test_walks_of_the_third_hop_are_told_apart_where_they_are_made(spark, monkeypatch):
    """A complete graph of twelve nodes: every other node is an end, and no walk is dealt anew after its node's ends were added."""
    plans = []
    real = traverse.cut_lineage
    monkeypatch.setattr(traverse, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or real(d))
    ids = spark.range(12).selectExpr("concat('n', id) AS node_id")
    edges = ids.withColumnRenamed("node_id", "source_node_id").crossJoin(ids.withColumnRenamed("node_id", "target_node_id")).selectExpr(
        "concat(source_node_id, target_node_id) AS edge_id", "source_node_id", "target_node_id", "'weak' AS current_weight_band",
        "'' AS falsification_criteria", "false AS deprecated")
    got = traverse.projection_totals(edges, ids, 3).filter("hops = 3").collect()
    assert {(r["n_ends"], r["n_paths"]) for r in got} == {(11, 11 * 10 * 9)} and len(got) == 12
    made = [p for p in plans if "Generate explode(ends" in p]
    assert len(made) == 1 and "Exchange" not in made[0].split("Generate explode(ends")[0]


def _complete(ids):
    return ids.withColumnRenamed("node_id", "source_node_id").crossJoin(ids.withColumnRenamed("node_id", "target_node_id")).selectExpr(
        "concat(source_node_id, target_node_id) AS edge_id", "source_node_id", "target_node_id", "'weak' AS current_weight_band",
        "'' AS falsification_criteria", "false AS deprecated")


def test_walks_of_two_hops_are_summed_where_they_are_made(spark, monkeypatch):
    """What leaves a middle node becomes rows in the task of the start; no walk is dealt anew, nor kept as a row of a checkpoint."""
    plans = []
    real = traverse.cut_lineage
    monkeypatch.setattr(traverse, "cut_lineage", lambda d: plans.append((d._jdf.queryExecution().executedPlan().toString(), d.count())) or real(d))
    ids = spark.range(12).selectExpr("concat('n', id) AS node_id")
    got = traverse.projection_totals(_complete(ids), ids, 3).filter("hops = 2").collect()
    assert {(r["n_ends"], r["n_paths"]) for r in got} == {(11, 11 * 10)} and len(got) == 12
    made = [(plan, n) for plan, n in plans if "Generate inline(steps" in plan]
    assert len(made) == 1 and made[0][1] == 12 and "Exchange" not in made[0][0].split("Generate inline(steps")[0]


def test_starts_with_the_same_ends_share_copies(spark, monkeypatch):
    """Two graphs without an edge between them: each share of the starts takes the nodes of one."""
    monkeypatch.setattr(traverse, "SHARES", 2)
    ids = spark.range(24).selectExpr("concat(CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END, id) AS node_id")
    edges = _complete(ids).filter("left(source_node_id, 1) = left(target_node_id, 1)")
    pairs, names = traverse._factors(edges)
    shares = traverse._shares(pairs.select(F.col("a").alias("s"), F.col("b").alias("x")), pairs)
    dealt = shares.join(names.toDF("node", "s"), "s").select(F.left("node", F.lit(1)).alias("graph"), "share").distinct().collect()
    assert len(dealt) == 2 and len({r["share"] for r in dealt}) == 2


def test_two_full_blocks_are_linked_in_strips():
    """Groups of four equal vectors; products of all pairs would take 128 MB, their comparison takes 16 MB."""
    x = np.random.default_rng(3).normal(size=(1000, 64))
    x = np.tile(x / np.linalg.norm(x, axis=1, keepdims=True), (4, 1))
    tracemalloc.start()
    label = vectors._spanning(x, np.ones(4000, dtype=bool), 0.92)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (label == np.arange(4000) % 1000).all()
    assert peak < 48_000_000


def test_responses_of_one_file_are_parsed_once_by_all_tasks(spark, monkeypatch):
    seen = []
    real = extract.cut_lineage
    monkeypatch.setattr(extract, "cut_lineage", lambda d: seen.append((d.rdd.getNumPartitions(), d._jdf.queryExecution().executedPlan().toString())) or real(d))
    good = '{"operation":"add_supporting_signal","target_edge_id":"e","signal_id":"s"}'
    bodies = [(1, f"[{good}, 5]"), (1, f"so: [{good}] end"), (2, "[]"), (3, "none"), (3, "[7]"), (None, f"[{good}]")]
    d = spark.createDataFrame(bodies, "batch_id long, body string").coalesce(1)
    rows, counts = extract.response_operations(d)
    assert sorted(map(tuple, counts.collect()), key=str) == [
        (1, True, 2, 1), (1, True, 2, 1), (2, True, 0, 0), (3, False, 0, 1), (3, True, 0, 1), (None, True, 0, 0)]
    assert sorted((r["batch_id"], r["pos"]) for r in rows.collect() if r["batch_id"]) == [(1, 0), (1, 0)]
    assert [n for n, _ in seen] == [4]
    assert not [line for _, plan in seen for line in plan.splitlines() if "Filter" in line and "json" in line]


def test_names_that_share_their_words_meet_claims_as_one(spark, monkeypatch):
    """Two phrases with 60 numbers each: claims meet a few kinds, and numbers in claims still count."""
    monkeypatch.setattr(similarity, "SLABS", (10, 40, 80))
    met = []
    real = similarity._near_pairs
    monkeypatch.setattr(similarity, "_near_pairs", lambda names, *a: met.append((names.count(), len(a) > 4 and a[4] is not None)) or real(names, *a))
    rng = random.Random(7)
    edges = [(n, f"bank credit {n * 37}", f"oil export supply {n}" if n % 4 else "zebra") for n in range(60)]
    words = ["bank", "credit", "oil", "export", "supply", "river", "bankrupt", "the", "boil", "37", "1147", "111", "59"]
    start = datetime(2024, 1, 1)
    signals = [(n, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))), start + timedelta(hours=rng.randrange(50))) for n in range(250)]
    got = similarity.signals_near_edges(
        spark.createDataFrame(edges, "edge_id long, source_name string, target_name string"),
        spark.createDataFrame(signals, "signal_id long, claim_text string, content_timestamp timestamp"), above=0.3, k=6)
    assert {(r["edge_id"], r["signal_id"]) for r in got.collect()} == _brute_near(edges, signals, 0.3, 6)
    assert met and max(n for n, whole in met if whole) <= 20


def test_claims_are_kept_as_lists_of_the_trigrams_that_names_have(spark, monkeypatch):
    """A claim's own trigrams are neither shuffled nor written, and triggers of operations are not sorted out of all near signals."""
    written = []
    for name in ("cut_lineage", "stored"):
        real = getattr(similarity, name)
        monkeypatch.setattr(similarity, name, lambda d, real=real: written.append(d.schema) or real(d))
    monkeypatch.setattr(similarity, "BROADCAST_TEXTS", 0)
    edges = spark.range(4).selectExpr("id AS edge_id", "concat('copper ', id) AS source_name", "'none' AS target_name")
    signals = spark.range(60).selectExpr(
        "id AS signal_id", "concat('copper among other words ', id) AS claim_text",
        "timestamp '2024-01-01' + id * interval '1' hour AS content_timestamp")
    pointed, lists = similarity.near_lists(edges, signals, k=5)
    assert {len(r["near"]) for r in pointed.join(lists, ["source", "target"]).collect()} == {5}
    assert not [s for s in written if {"newest", "grams"} <= set(s.fieldNames())]
    told = [s for s in written if {"newest", "ranked", "size"} <= set(s.fieldNames())]
    assert told and "string" not in told[0].simpleString()


def test_claims_meet_many_tails_by_the_trigrams_of_tails_only(spark, monkeypatch):
    """With tails that are too many to be broadcast, what is dealt out are the claims' trigrams that some tail has."""
    monkeypatch.setattr(similarity, "BROADCAST_GRAMS", 40)
    edges = [(n, f"copper ring {n}", "none") for n in range(30)]
    start = datetime(2024, 1, 1)
    signals = [(n, f"copper among a few words {n % 20 + 100}", start + timedelta(hours=n)) for n in range(40)]
    got = similarity.signals_near_edges(
        spark.createDataFrame(edges, "edge_id long, source_name string, target_name string"),
        spark.createDataFrame(signals, "signal_id long, claim_text string, content_timestamp timestamp"), above=0.15, k=7)
    assert {(r["edge_id"], r["signal_id"]) for r in got.collect()} == _brute_near(edges, signals, 0.15, 7)


def test_answers_are_not_parsed_to_filter_the_rows_they_came_from(spark):
    d = spark.range(20).selectExpr("concat('e', id % 5) AS edge_id").distinct().selectExpr(
        "edge_id", "concat('{\"outcome\":\"found\",\"operations\":[{\"operation\":\"update_edge_weight\",\"target_edge_id\":\"', edge_id, '\"}]}') AS body")
    ops = review.challenge_operations(review.parse_challenges(d))
    plan = ops._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "json" in line]
    assert sorted(r["target_edge_id"] for r in ops.collect()) == [f"e{n}" for n in range(5)]


def test_a_text_is_scored_once_for_all_its_lenses(monkeypatch):
    made = []
    real = json.dumps
    monkeypatch.setattr(json, "dumps", lambda x: made.append(x) or real(x))
    texts = ["oil export halted. more", None, "zzz", "oil export halted. more"]
    pdf = pd.DataFrame([(str(n), lens, t) for n, t in enumerate(texts) for lens in "abc"], columns=["payload_id", "lens_id", "content"])
    out = pd.concat(extract.keyword_scorer([pdf]))
    assert list(zip(out["payload_id"], out["lens_id"])) == list(zip(pdf["payload_id"], pdf["lens_id"]))
    hits = out[out["body"] != "[]"]
    assert set(hits["payload_id"]) == {"0", "3"} and len(hits) == 6 and hits["body"].nunique() == 1
    assert len(made) == 1


def test_micro_batches_of_a_fold_read_resolved_events(spark, monkeypatch):
    """What the files of the micro-batches are written from holds no join, so its tasks hold none of their memory."""
    plans = []
    real = stream_checks.in_files
    monkeypatch.setattr(stream_checks, "in_files", lambda t, d, *a, **b: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or real(t, d, *a, **b))
    assert stream_checks.folded(Tables(spark, "/root/testdata/sf0.001"), "nodes").count() > 0
    assert len(plans) == 1 and "Join" not in plans[0]


def test_references_that_are_no_ids_are_spread_over_tasks(spark):
    ops = spark.range(400).selectExpr(
        "concat('b', id % 40) AS batch_id", "timestamp '2024-01-01' AS batch_time", "concat('e', id) AS event_id", "concat('S', id % 10) AS ref")
    slugs = spark.createDataFrame([(f"b{n}", "s1", f"n{n}") for n in range(40)], "batch_id string, slug string, node_id string")
    known = spark.createDataFrame([("id7", None)], "node_id string, since struct<batch_time:timestamp,batch_id:string>")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        d = mutate.resolve_refs(ops, "ref", "out", slugs, known, "^id")
        parts = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
        assert d.filter("out IS NOT NULL").count() == 40 and sum(parts) == 400 and max(parts) < 200
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_tracked_rows_are_read_once_and_meet_others_by_signal_only(spark):
    """Signals without an edge would share the null key of a join by edge."""
    tracked = spark.range(77, 477).selectExpr("id AS signal_id", "'s' AS source_id", "'market' AS lens_id", "timestamp '2024-01-01' AS content_timestamp")
    signals = spark.range(0, 300).selectExpr("id AS signal_id", "CASE WHEN id % 2 = 0 THEN 'c' END AS cluster_id")
    events = spark.createDataFrame([(n, n > 3, f"e{n}", datetime(2024, 1, n)) for n in range(1, 6)], "event_id long, rejected boolean, target_edge_id string, applied_at timestamp")
    triggers = spark.createDataFrame([(1, 100), (2, 100), (1, 102), (3, 103), (4, 104)], "event_id long, signal_id long")
    edges = spark.createDataFrame([("e1", True), ("e2", False)], "edge_id string, deprecated boolean")
    history = spark.createDataFrame([("e2", 1, "weakened", datetime(2024, 1, 1))], "edge_id string, id long, change_type string, content_timestamp timestamp")
    d = calibrate.resolve(calibrate.register(None, tracked, "run"), cutoff=datetime(2024, 2, 1), signals=signals, events=events,
                          triggers=triggers, edges=edges, weight_history=history)
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Range (77, 477") == 1
    got = {r["signal_id"]: r["outcome"] for r in d.collect()}
    assert [got[n] for n in (100, 102, 103, 104, 105, 400)] == [
        "anchored_weakened", "anchored_deprecated", "anchored_persistent", "clustered_but_not_anchored", "isolated_in_tier_a", "extraction_rejected"]
    assert len(got) == 400


def test_changes_are_counted_by_topic_without_their_texts(spark, monkeypatch):
    plans = []
    real = changes.cut_lineage
    monkeypatch.setattr(changes, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or real(d))
    assert QUERIES["changes_by_topic"](Tables(spark, "/root/testdata/sf0.001").spark, "/root/testdata/sf0.001").count() > 0
    assert len(plans) == 1 and "Contains" not in plans[0] and "Condition " not in plans[0] and "market and oil price" not in plans[0]


def test_convergent_claims_are_counted_without_repeating_rows(spark):
    rows = [(1, 1, "a", " X "), (2, 1, "b", "x"), (3, 2, None, "x"), (4, 2, "a", "y"), (5, 3, "a", "y"), (6, 3, "b", None), (7, 3, "c", None)]
    d = quality.convergence(spark.createDataFrame(rows, "signal_id long, payload_id long, lens_id string, claim_text string"))
    assert "Expand" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, d.drop("claim_hash").collect())) == [(2, 1, 2, 6), (3, 2, 2, 1)]


def test_edges_alone_between_their_ends_need_no_pair_join_and_no_salt(spark):
    schema = "edge_id string, source_node_id string, target_node_id string, deprecated boolean"
    rows = [("e1", "a", "b", False), ("e2", "b", "c", False), ("e3", "c", "d", True), ("e4", "a", "c", False)]
    d = traverse.blast_radius(spark.createDataFrame(rows, schema))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    assert {r["edge_id"]: r["blast_radius"] for r in d.collect()} == {"e1": 2, "e2": 2, "e3": 2, "e4": 2}
    more = spark.createDataFrame(rows + [("e6", "d", "c", False), ("e7", "b", "a", True)], schema)
    assert {r["edge_id"]: r["blast_radius"] for r in traverse.blast_radius(more).collect()} == {
        "e1": 2, "e2": 3, "e3": 3, "e4": 3, "e6": 2, "e7": 3}


def test_signals_meet_their_names_and_not_their_group(spark, monkeypatch):
    """Names chain all signals into one group; what is written in between is one row per pair of names."""
    sizes = []
    real = components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda d: sizes.append((out := real(d)).count()) or out)
    signals = spark.range(10, 310).withColumnRenamed("id", "signal_id")
    names = spark.range(0, 320).selectExpr("id AS signal_id", "explode(array(concat('N', id % 5), concat(' n', (id + 1) % 5), '')) AS name")
    names = names.unionAll(spark.createDataFrame([(309, "lone"), (400, "gone")], names.schema))
    d = components.group_signals(signals.unionAll(spark.createDataFrame([(900,)], "signal_id long")), names)
    assert {(r["signal_id"], r["group_id"]) for r in d.collect()} == {(n, 10) for n in range(10, 310)} | {(900, 900)}
    assert d._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 320") == 1
    assert max(sizes) <= 16


def _counted(df, met):
    """The same rows; every row that is read is counted."""
    def count(frames):
        for f in frames:
            met.add(len(f))
            yield f

    return df.mapInPandas(count, df.schema)


def test_trigrams_are_built_per_distinct_text(spark, monkeypatch):
    built = spark.sparkContext.accumulator(0)
    real = similarity.trigrams
    same = F.udf(lambda x: built.add(1) or x, "string")
    monkeypatch.setattr(similarity, "trigrams", lambda c: real(same(c)))
    questions = spark.range(900).selectExpr("concat('why is part ', id % 3) AS q")
    nodes = spark.range(900).selectExpr("concat('n', id) AS node_id", "concat('part ', id % 4) AS name")
    got = {(r["query"], r["node_id"]) for r in similarity.search_names(questions, "q", nodes, k=2).collect()}
    assert got == {("why is part 0", "n0"), ("why is part 0", "n100"), ("why is part 1", "n1"), ("why is part 1", "n101"),
                   ("why is part 2", "n10"), ("why is part 2", "n102")}
    assert built.value <= 100


def test_question_context_reads_signals_and_edges_once(spark):
    start = datetime(2024, 1, 1)
    nodes = [(f"n{i}", "entity", f"part {i}", None, "active", start, None) for i in range(6)]
    edges = [(f"e{i}", f"n{i % 6}", f"n{(i + 1) % 6}", f"part {i % 6}", f"part {(i + 1) % 6}", "causes", "weak" if i % 2 else "strong",
              False, None, start, start + timedelta(hours=i)) for i in range(60)]
    signals = [(i, f"news of PART {i % 9} and more", "market", "inference", start + timedelta(days=i % 80)) for i in range(400)]
    met = [spark.sparkContext.accumulator(0) for _ in range(2)]
    d = topics.question_context(
        spark.createDataFrame([("part 2",), ("part 2",), ("none",)], "question string"),
        spark.createDataFrame(nodes, "node_id string, node_type string, name string, description string, current_state string, "
                                     "created_at timestamp, dimension string"),
        _counted(spark.createDataFrame(
            edges, "edge_id string, source_node_id string, target_node_id string, source_name string, target_name string, edge_type string, "
                   "current_weight_band string, deprecated boolean, reasoning string, created_at timestamp, updated_at timestamp"), met[0]),
        _counted(spark.createDataFrame(
            signals, "signal_id long, claim_text string, lens_id string, confidence_band string, content_timestamp timestamp"), met[1]),
        as_of=start + timedelta(days=60), k=(1, 4, 3))
    got = {(r["part"], r["position"]): (r["query"], r["item_id"], r["label"], r["state"]) for r in d.collect()}
    near = sorted((e for e in edges if "n2" in e[1:3]), key=lambda e: (e[6] != "strong", -e[10].timestamp()))[:4]
    told = sorted((s for s in signals if "PART 2 " in s[1] and timedelta(30) <= s[4] - start <= timedelta(60)),
                  key=lambda s: (s[4], s[0]), reverse=True)[:3]
    want = {("node", 1): ("part 2", "n2", "part 2", "active")}
    want |= {("edge", i): ("part 2", e[0], e[3], e[6]) for i, e in enumerate(near, 1)}
    want |= {("signal", i): ("part 2", str(s[0]), s[1], "inference") for i, s in enumerate(told, 1)}
    assert got == want
    assert [m.value for m in met] == [60, 400]


def test_containing_without_broadcast_and_without_terms(spark, monkeypatch):
    texts = spark.createDataFrame([("Red bolt",), ("a",), ("ring",), (None,)], "t string")
    terms = spark.createDataFrame([("bol",), ("A",), ("ri",), ("",), ("zzz",)], "w string")
    assert similarity.containing(texts, "t", terms.filter("w = ''"), "w").count() == 0
    for most in (similarity.BROADCAST_GRAMS, -1):
        monkeypatch.setattr(similarity, "BROADCAST_GRAMS", most)
        got = {tuple(r) for r in similarity.containing(texts, "t", terms, "w").collect()}
        assert got == {("Red bolt", "bol"), ("a", "A"), ("ring", "ri")}
