import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.plans import extract, ingest, review, scenarios

T = datetime(2024, 3, 1)


def signals(spark, body, lens="commodities"):
    d = spark.createDataFrame([("p", lens, body)], "payload_id string, lens_id string, body string")
    return extract.response_signals(d, vocab.lens_table(spark)).orderBy("pos").collect()


ITEM = {"claim_text": " Oil up ", "confidence_band": "inference", "reasoning": "r" * 1500}


@pytest.mark.parametrize("body,n", [
    (json.dumps([ITEM]), 1), ("```json\n" + json.dumps([ITEM]) + "\n```", 1), ("```\n[]\n```", 0),
    ("Sure: " + json.dumps([ITEM, ITEM]) + " done", 2), (json.dumps(ITEM), 0), ("no", 0), ("[broken", 0), ("", 0),
    (json.dumps(["text", 5, None, ITEM]), 1), (json.dumps([{"claim_text": "x" * 501}, {"claim_text": "x" * 500}]), 1),
    (json.dumps([{"claim_text": 5}]), 1), ('{"a": [1]}', 0), (json.dumps([ITEM] * 12), 10), ("] [", 0),
])
def test_parse_and_validate(spark, body, n):
    assert len(signals(spark, body)) == n


def test_fields(spark):
    r = signals(spark, json.dumps([ITEM, {"claim_text": "b", "confidence_band": "sure", "proposed_anchors": "none"}]))
    assert r[0]["claim_text"] == "Oil up" and len(r[0]["reasoning"]) == 1000 and r[0]["confidence_band"] == "inference"
    assert r[1]["confidence_band"] == "weak_inference" and r[1]["proposed_anchors"] == []


def test_scope_and_anchor_cap(spark):
    a = [{"operation": "create_node", "node_type": "entity", "fields": {"name": " Oil "}},
         {"operation": "create_node", "node_type": "claim"}, {"operation": "create_edge", "edge_type": "enables"},
         {"operation": "create_edge", "edge_type": "causes"}, {"operation": "update_node"}, "text"]
    r = signals(spark, json.dumps([{"claim_text": "c", "proposed_anchors": a}]))[0]
    assert [(x["operation"], x["node_type"] or x["edge_type"]) for x in r["proposed_anchors"]] == [
        ("create_node", "entity"), ("create_edge", "causes"), ("update_node", None)]
    many = [{"operation": "update_node"}] * 12
    assert len(signals(spark, json.dumps([{"claim_text": "c", "proposed_anchors": many}]))[0]["proposed_anchors"]) == 10
    none = signals(spark, json.dumps([{"claim_text": "c", "proposed_anchors": a}]), "disconfirmation")[0]
    assert [x["operation"] for x in none["proposed_anchors"]] == ["update_node"]
    d = spark.createDataFrame([("p", "commodities", json.dumps([{"claim_text": "c", "proposed_anchors": a[:1] * 2}]))],
                              "payload_id string, lens_id string, body string")
    got = extract.response_signals(d, vocab.lens_table(spark))
    assert [r["name"] for r in extract.entity_names(got).collect()] == ["oil"]
    named = got.select(F.lit("b").alias("batch_id"), F.lit(0).alias("signal_no"), "proposed_anchors")
    assert [(r["name"], r["name_no"]) for r in extract.batch_entity_names(named).collect()] == [(" Oil ", 0)]


def test_operations(spark):
    good = [
        {"operation": "create_node", "node_type": "entity", "proposed_id": "Iran-War_1", "reasoning": "r",
         "fields": {"name": "N", "entity_kind": "state", "aliases": ["x", "y"]}},
        {"operation": "update_node", "target_node_id": "t", "field_updates": {"a": 1}, "reasoning": "r"},
        {"operation": "create_edge", "source_node_id": "a", "target_node_id": "b", "edge_type": "causes",
         "proposed_weight_band": "weak", "reasoning": "r", "falsification_criteria": "f"},
        {"operation": "update_edge_weight", "target_edge_id": "e", "new_weight_band": "weak", "direction": "weaken", "reasoning": "r"},
        {"operation": "add_supporting_signal", "target_edge_id": "e", "signal_id": "s"},
    ]
    bad = [dict(good[0], proposed_id="no slug!"), dict(good[0], proposed_id="-_"), dict(good[0], node_type="galaxy"),
           {k: v for k, v in good[0].items() if k != "reasoning"}, dict(good[2], falsification_criteria=" "),
           dict(good[3], direction="sideways"), {"operation": "drop"}, "text"]
    body = "Here you go ```json\n" + json.dumps(good + bad) + "\n``` bye"
    d = spark.createDataFrame([("b", body), ("x", "nothing"), ("y", "[]"), ("z", '{"a": 1}')], "batch_id string, body string")
    rows, counts = extract.response_operations(d)
    c = {r["batch_id"]: (r["parsed"], r["n_valid"], r["n_skipped"]) for r in counts.collect()}
    assert c == {"b": (True, 5, 8), "x": (False, 0, 0), "y": (True, 0, 0), "z": (False, 0, 0)}
    first = rows.filter("pos = 0").first()
    assert first["proposed_id"] == "iran-war_1" and first["aliases"] == ["x", "y"] and first["fields"]["entity_kind"] == "state"
    assert rows.filter("pos = 1").first()["field_updates"] == {"a": "1"}


def test_cycle(spark):
    p = spark.createDataFrame([("p", "s", T), ("q", "s", T)], "payload_id string, source_id string, content_timestamp timestamp")
    one = json.dumps([{"claim_text": "Oil up"}])
    resp = spark.createDataFrame([("p", "commodities", one), ("p", "market", json.dumps([{"claim_text": "oil UP"}, {"claim_text": "gas"}])),
                                  ("q", "disconfirmation", one)], "payload_id string, lens_id string, body string")
    lens = vocab.lens_table(spark)
    new, found = extract.extraction_cycle(p, resp, lens, None, extracted_at=T)
    assert {(r["payload_id"], r["claim_text"]) for r in new.collect()} == {("p", "Oil up"), ("p", "gas")}
    assert found.count() == 1
    again, _ = extract.extraction_cycle(p, resp, lens, new, extracted_at=T)
    assert again.count() == 0
    edges = spark.createDataFrame([("e",)], "edge_id string")
    with_edges, _ = extract.extraction_cycle(p, resp, lens, None, extracted_at=T, challenge_edges=edges)
    assert with_edges.filter("lens_id = 'disconfirmation'").count() == 1


def test_model_call_per_payload_and_lens(spark):
    p = spark.createDataFrame([("p", "s", "Bank credit tightens.\nMore text."), ("q", "s", "zzz")],
                              "payload_id string, source_id string, content string")
    lens = vocab.lens_table(spark)
    d = extract.score_payloads(p, extract.keyword_scorer)
    assert d.count() == 14
    got = extract.response_signals(d, lens).select("payload_id", "claim_text").distinct().collect()
    assert [tuple(r) for r in got] == [("p", "Bank credit tightens")]


def test_challenge_responses(spark):
    ops = [{"operation": "add_disconfirming_signal", "target_edge_id": "e", "signal_id": "s"}, {"operation": "create_edge"}]
    bodies = {
        "a": json.dumps({"outcome": "found", "reasoning": "x" * 2500, "operations": ops}),
        "b": "```json\n" + json.dumps({"outcome": "not_found", "reasoning": "ok", "operations": ops}) + "\n```",
        "c": "Well, " + json.dumps({"outcome": "maybe"}) + ".", "d": "none", "e": "{broken}", "f": "[1]",
    }
    d = spark.createDataFrame(list(bodies.items()), "edge_id string, body string")
    parsed = review.parse_challenges(d)
    got = {r["edge_id"]: r for r in parsed.collect()}
    assert [got[k]["outcome"] for k in "abcdef"] == ["found", "not_found", "error", "error", "error", "error"]
    assert len(got["a"]["reasoning"]) == 2000 and got["b"]["operations"] == []
    assert got["d"]["reasoning"] == "No JSON found in LLM output."
    assert got["e"]["reasoning"] == "Could not parse LLM output."
    assert got["f"]["reasoning"] == "LLM returned non-object JSON."
    assert [r["operation"] for r in review.challenge_operations(parsed).collect()] == ["add_disconfirming_signal"]


def test_challenge_pass(spark):
    from datetime import timedelta

    nodes = spark.createDataFrame([("o", "condition", "Oil export ban", None, T, T), ("b", "condition", "Bank stress", None, T, T)],
                                  "node_id string, node_type string, name string, description string, created_at timestamp, updated_at timestamp")
    e = lambda i, band="strong": (i, "o", "b", "causes", band, "f", None, False, T, T)
    edges = spark.createDataFrame([e("e1"), e("e2"), e("e3", "moderate")],
        "edge_id string, source_node_id string, target_node_id string, edge_type string, current_weight_band string, "
        "falsification_criteria string, last_disconfirmation_pass timestamp, deprecated boolean, created_at timestamp, updated_at timestamp")
    sig = spark.createDataFrame([(i, "Oil export ban eased", T + timedelta(hours=i), T) for i in range(12)],
                                "signal_id long, claim_text string, content_timestamp timestamp, extracted_at timestamp")
    body = json.dumps({"outcome": "found", "reasoning": "r", "operations": [
        {"operation": "update_edge_weight", "target_edge_id": "e1", "new_weight_band": "moderate", "direction": "weaken", "reasoning": "r"},
        {"operation": "update_edge_weight", "target_edge_id": "gone", "new_weight_band": "weak", "direction": "weaken", "reasoning": "r"}]})
    resp = spark.createDataFrame([("e1", body, False), ("e2", None, True), ("e3", '{"outcome": "not_found"}', False)],
                                 "edge_id string, body string, failed boolean")
    out = review.run_pass(edges, nodes, sig, resp, now=T + timedelta(days=1))
    log = {r["edge_id"]: r["outcome"] for r in out["log"].collect()}
    assert log == {"e1": "found", "e2": "error", "e3": "not_found"}
    after = {r["edge_id"]: r for r in out["edges"].collect()}
    assert after["e1"]["current_weight_band"] == "moderate"
    assert after["e2"]["last_disconfirmation_pass"] is None and after["e3"]["last_disconfirmation_pass"] is not None
    ev = {r["rejected"]: r for r in out["events"].collect()}
    assert len(ev[False]["triggered_by"]) == 10 and ev[False]["source"] == "disconfirmation" and ev[True]["rejection_reason"]
    assert out["signals"].count() == 36


def test_scenarios(spark):
    body = "```json\n" + json.dumps([
        {"title": " A ", "summary": "s", "probability_band": "HIGH "}, {"title": "B", "summary": "s", "probability_band": "certain", "time_horizon": "1 year"},
        {"title": "", "summary": "s"}, "text"]) + "\n```"
    S = "dimension string, body string, as_of timestamp, generated_at timestamp, model_used string"
    d = spark.createDataFrame([("economic_stability", body, T, T, "m"), ("structural_change", "oops", T, T, "m")], S)
    one = scenarios.projection_cycle(d, None, save_no=1)
    got = sorted((r["title"], r["probability_band"], r["time_horizon"]) for r in one.collect())
    assert got == [("A", "high", "3–6 months"), ("B", "moderate", "1 year")]
    with pytest.raises(ValueError):
        scenarios.projection_cycle(spark.createDataFrame([("nope", body, T, T, "m")], S), None, save_no=1)
    later = spark.createDataFrame([("economic_stability", json.dumps([{"title": "C", "summary": "s"}]), T, T.replace(day=2), "m")], S)
    both = one.unionByName(scenarios.projection_cycle(later, one, save_no=2))
    flagged = scenarios.with_deprecation(both)
    assert {r["title"] for r in scenarios.read_scenarios(flagged, as_of=T.replace(day=9)).collect()} == {"C"}
    every = scenarios.read_scenarios(flagged, as_of=T.replace(day=9), include_deprecated=True, limit=20).collect()
    assert [r["title"] for r in every] == ["C", "A", "B"]
    assert scenarios.read_scenarios(flagged, as_of=T.replace(day=9), dimension="structural_change").count() == 0
    nulls = both.withColumn("dimension", F.lit(None).cast("string"))
    assert scenarios.with_deprecation(nulls).filter("deprecated").count() == 2


def test_ingest_cycle(spark, folder):
    good = "A perfectly ordinary paragraph about shipping lanes that is long enough to be kept by rule one."
    rows = [("s", f"u{i}", "us_eu", c, T, None, "article", "en", {"k": "v"}) for i, c in enumerate([good, good, "short"])]
    d = spark.createDataFrame(rows, "source_id string, url string, perspective string, content string, fetched_at timestamp, "
                              "content_timestamp timestamp, content_type string, language string, metadata map<string,string>")
    counts = ingest.run_all(d, None, now=T, store=f"{folder}/store", archive=f"{folder}/archive").collect()
    assert [tuple(r) for r in counts] == [("s", 1)]
    stored = spark.read.parquet(f"{folder}/store")
    assert stored.count() == 3 and stored.filter("rejected").count() == 2
    assert "PartitionFilters: [isnotnull(source_id" in stored.filter("source_id = 's'")._jdf.queryExecution().executedPlan().toString()
    assert spark.read.json(f"{folder}/archive").count() == 1
