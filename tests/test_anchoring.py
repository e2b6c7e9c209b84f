import json
from datetime import datetime, timedelta

import pytest

from evgraph.operators import mutate
from evgraph.plans import anchoring, calibrate, home

T = datetime(2024, 3, 1)


def test_context_is_packed_like_the_joined_text(spark):
    nodes = [(f"n{i}", "condition", f"Oil item {i}", "d" * 300 if i % 2 else None) for i in range(12)]
    edges = [(f"e{i:02d}", "n0", f"n{i}", "causes", "strong", "f" * 300, "why", False) for i in range(1, 12)]
    nd = spark.createDataFrame(nodes, "node_id string, node_type string, name string, description string")
    ed = spark.createDataFrame(edges, "edge_id string, source_node_id string, target_node_id string, edge_type string, "
                               "current_weight_band string, falsification_criteria string, reasoning string, deprecated boolean")
    names = spark.createDataFrame([("b", 0, "Oil item 0")], "batch_id string, name_no long, name string")
    got = anchoring.batch_context(names, nd, ed, budget=1500).collect()

    members = sorted(n for n in nodes)
    lines = [f"**Tier B subgraph** ({len(members)} nodes, {len(edges)} edges)\n", "### Nodes"]
    want = set()
    for i, k, name, desc in sorted(members):
        lines.append(f"- [{k}] **{name}** (id={i})" + (f" — {desc[:120]}" if desc else ""))
        want.add(("nodes", i))
        if len("\n".join(lines)) > 900:
            lines.append("  *(node list truncated)*")
            break
    lines.append("\n### Edges")
    for e in edges:
        lines.append(f"- {e[1]} --causes--> {e[2]} [strong] (id={e[0]})\n  *reasoning*: why\n  *falsification*: {'f' * 200}")
        want.add(("edges", e[0]))
        if len("\n".join(lines)) > 1500:
            break
    assert {(r["section"], r["item"]) for r in got} == want
    assert max(r["used"] for r in got) == len("\n".join(lines))


def test_cycle_applies_and_marks(spark):
    s = spark.createDataFrame([(i, f"lens{i % 2}", T + timedelta(minutes=i), T) for i in range(4)],
                              "signal_id long, lens_id string, content_timestamp timestamp, extracted_at timestamp")
    e = spark.createDataFrame([(0, "Oil"), (1, "oil"), (2, "Gas"), (3, "gas")], "signal_id long, name string")
    b = anchoring.make_batches(s, e, now=T)
    ids = sorted({r["batch_id"] for r in b.collect()})
    assert ids == ["0-0", "2-0"]
    ops = [{"operation": "create_node", "node_type": "entity", "proposed_id": "oil", "reasoning": "r",
            "fields": {"name": "Oil", "entity_kind": "commodity", "aliases": ["Crude"]}},
           {"operation": "create_node", "node_type": "entity", "proposed_id": "gas", "reasoning": "r",
            "fields": {"name": "Gas", "entity_kind": "commodity"}},
           {"operation": "create_edge", "source_node_id": "OIL", "target_node_id": "gas", "edge_type": "causes",
            "proposed_weight_band": "weak", "reasoning": "r", "falsification_criteria": "f"},
           {"operation": "create_edge", "source_node_id": "oil", "target_node_id": "none", "edge_type": "causes",
            "proposed_weight_band": "weak", "reasoning": "r", "falsification_criteria": "f"}]
    resp = spark.createDataFrame([("0-0", json.dumps(ops))], "batch_id string, body string")
    out = anchoring.anchoring_cycle(b, resp, mutate.empty_graph(spark), seq=1)
    r = out["report"].collect()
    assert [(x["batch_id"], x["n_signals"], x["n_applied"], x["n_rejected"]) for x in r] == [("0-0", 2, 3, 1)]
    assert {x["signal_id"] for x in out["states"].collect()} == {0, 1}
    edge = out["graph"].edges.first()
    assert edge["created_at"] == T and out["graph"].nodes.count() == 2
    assert {x["alias_text"] for x in out["graph"].aliases.collect()} == {"Oil", "Gas", "Crude"}
    ev = out["events"].filter("event_type = 'create_edge' AND NOT rejected").first()
    assert ev["triggered_by"] == ["0", "1"]


def test_change_log_bounds():
    for kw in ({"hours": 0}, {"hours": 721}, {"limit": 0}, {"limit": 101}):
        with pytest.raises(ValueError):
            home.change_log(as_of=T, **kw)


def test_home_view_has_notes_only_when_live(spark):
    none = lambda s: spark.createDataFrame([], s)
    nodes = none("node_id string, node_type string, name string, description string, current_state string, created_at timestamp")
    edges = none("edge_id string, source_node_id string, target_node_id string, edge_type string, current_weight_band string, "
                 "deprecated boolean, created_at timestamp")
    w = none("id long, edge_id string, weight_band string, previous_weight_band string, change_type string, content_timestamp timestamp")
    s = none("id long, node_id string, new_state string, previous_state string, content_timestamp timestamp")
    tn = none("topic_id string, node_id string")
    notes = spark.createDataFrame([("structural_change", "calm")], "dimension string, note string")
    live, log = home.home_view(nodes, edges, w, s, tn, notes, now=T)
    assert {r["note"] for r in live.collect()} == {"", "calm"} and log.count() == 0
    past, _ = home.home_view(nodes, edges, w, s, tn, notes, now=T, as_of=T)
    assert {r["note"] for r in past.collect()} == {""}
    assert {r["direction"] for r in past.collect()} == {"unknown"}


def test_live_checkpoint_waits_ninety_days(spark):
    S = "signal_id long, source_id string, lens_id string, content_timestamp timestamp"
    t = calibrate.register(None, spark.createDataFrame([(1, "s", "m", T - timedelta(days=91)), (2, "s", "m", T)], S), "live")
    none = lambda s: spark.createDataFrame([], s)
    d = calibrate.checkpoint_live(
        t, now=T, signals=none("signal_id long, cluster_id string"),
        events=none("event_id long, target_edge_id string, rejected boolean, applied_at timestamp"),
        triggers=none("event_id long, signal_id long"), edges=none("edge_id string, deprecated boolean"),
        weight_history=none("id long, edge_id string, change_type string, content_timestamp timestamp"))
    assert {r["signal_id"]: r["outcome"] for r in d.collect()} == {1: "extraction_rejected", 2: "pending"}
