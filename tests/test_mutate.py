import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evgraph.operators import mutate
from evgraph.operators.mutate import REJECTIONS as R

T0 = datetime(2024, 1, 1)
COLS = ("batch_id string, batch_time timestamp, pos long, operation string, proposed_id string, node_type string, "
        "fields map<string,string>, aliases array<string>, target_node_id string, field_updates map<string,string>, "
        "source_ref string, target_ref string, edge_type string, weight_band string, falsification_criteria string, "
        "target_edge_id string, new_weight_band string, direction string, signal_id string, source string")
NAMES = [c.strip().split(" ")[0] for c in COLS.split(", ")]
UUID = "11111111-2222-3333-4444-555555555555"


def ops(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], COLS)


def op(pos, operation, batch="b1", day=0, **kw):
    return {"batch_id": batch, "batch_time": T0 + timedelta(days=day), "pos": pos, "operation": operation,
            "source": "anchoring", **kw}


def node(pos, slug, name, kind="entity", aliases=None, batch="b1", day=0, **fields):
    extra = {"entity": {"entity_kind": "state"}, "claim": {"claim_text": "c", "claim_kind": "factual"}}
    return op(pos, "create_node", batch, day, proposed_id=slug, node_type=kind, aliases=aliases,
              fields={"name": name, **extra.get(kind, {}), **fields})


def edge(pos, a, b, batch="b1", day=0, **kw):
    return op(pos, "create_edge", batch, day, **{"source_ref": a, "target_ref": b, "edge_type": "causes",
                                              "weight_band": "weak", "falsification_criteria": "f", **kw})


def reasons(events):
    return {(r["batch_id"], r["phase"], r["pos"]): r["rejection_reason"] for r in events.collect()}


def test_every_rejection_reason(spark):
    g = mutate.empty_graph(spark)
    g.edges = spark.createDataFrame([("e-live", "x", "y", "causes", "weak", "f", False, T0, T0),
                                     ("e-dead", "x", "y", "causes", "weak", "f", True, T0, T0)], mutate.EDGE_SCHEMA)
    rows = [
        node(0, "a", "A", kind="galaxy"), node(1, "b", "  "), node(2, "c", "C", entity_kind=""),
        op(3, "create_node", proposed_id="d", node_type="event", fields={"name": "D"}),
        op(4, "create_node", proposed_id="e", node_type="event", fields={"name": "E", "occurred_at": "t"}),
        op(5, "create_node", proposed_id="f", node_type="quantity", fields={"name": "F"}),
        node(6, "g", "G", kind="claim", claim_text=" "), node(7, "h", "H", kind="claim", claim_kind=""),
        node(8, "Ok1", "Ok one"), node(9, "ok2", "Ok two"),
        op(0, "update_node", target_node_id="nope", field_updates={"x": "1"}),
        op(1, "update_node", target_node_id="OK1", field_updates={}),
        edge(0, "ok1", "ok2", edge_type="influences"), edge(1, "ok1", "ok2", weight_band="huge"),
        edge(2, "ok1", "ok2", falsification_criteria=" "), edge(3, "nope", "ok2"), edge(4, "ok1", UUID),
        edge(5, "ok1", "OK1"), edge(6, "ok1", "ok2"),
        op(0, "update_edge_weight", target_edge_id="e-live", new_weight_band="huge"),
        op(1, "update_edge_weight", target_edge_id="none", new_weight_band="weak"),
        op(2, "update_edge_weight", target_edge_id="e-dead", new_weight_band="weak"),
        op(3, "update_edge_weight", target_edge_id="e-live", new_weight_band="strong", direction="strengthen"),
        op(0, "add_supporting_signal", target_edge_id="e-dead", signal_id=UUID),
        op(1, "add_supporting_signal", target_edge_id="e-live", signal_id="s"),
        op(0, "add_disconfirming_signal", target_edge_id="none", signal_id=UUID),
    ]
    events = mutate.validate(ops(spark, *rows), g)
    got = reasons(events)
    want = {
        0: [R["node_type"], R["name"], R["entity_kind"], R["occurred_at"], R["event_kind"], R["unit"],
            R["claim_text"], R["claim_kind"], None, None],
        1: [R["target"], None],
        2: [R["edge_type"], R["band"], R["falsification"], R["source"], R["target"], R["self_loop"], None],
        3: [R["band"], R["edge"], R["deprecated"], None],
        4: [None, "signal_id is not a valid UUID: 's'"],
        5: [R["edge"]],
    }
    for phase, rs in want.items():
        assert [got[("b1", phase, i)] for i in range(len(rs))] == rs
    kinds = {r["event_type"] for r in events.collect()}
    assert "update_node_noop" in kinds
    t = mutate.batch_totals(events).first()
    assert t["n_applied"] + t["n_rejected"] == len(rows)


def test_first_creation_owns_the_name_and_its_aliases(spark):
    g = mutate.empty_graph(spark)
    g.aliases = spark.createDataFrame([("US", "United States", None), ("Known", "K", "n-known")], mutate.ALIAS_SCHEMA)
    rows = [
        node(0, "a", "United States"), node(1, "b", "us", batch="b2", day=1),
        node(2, "c", "KNOWN"), node(3, "d", "Big Bank", aliases=["BB", "Bank B"]),
        node(4, "e", "bb", aliases=["Chain"]), node(5, "f", "chain"), node(6, "g", "Big bank "),
    ]
    ev = {r["pos"]: r for r in mutate.validate(ops(spark, *rows), g).collect()}
    kind = {p: r["event_type"] for p, r in ev.items()}
    assert kind == {0: "create_node", 1: "create_node_aliased", 2: "create_node_aliased", 3: "create_node",
                    4: "create_node_aliased", 5: "create_node", 6: "create_node_aliased"}
    assert ev[1]["target_node"] == ev[0]["target_node"] and ev[2]["target_node"] == "n-known"
    assert ev[4]["target_node"] == ev[6]["target_node"] == ev[3]["target_node"]


def test_update_and_histories(spark):
    g = mutate.empty_graph(spark)
    rows = [
        node(0, "c", "Cond", kind="condition", current_state="inactive"),
        node(1, "k", "Claim", kind="claim"),
        op(2, "update_node", target_node_id="c", field_updates={"current_state": "active", "x": "1"}),
        op(3, "update_node", target_node_id="c", field_updates={"name": "New", "x": "2"}),
    ]
    events, after = mutate.apply_batches(ops(spark, *rows), g)
    c = after.nodes.filter("node_type = 'condition'").first()
    assert c["name"] == "New" and c["type_data"] == {"current_state": "active", "x": "2"}
    h = mutate.value_history(events, g.nodes, "current_state").orderBy("phase").collect()
    assert [(r["previous_value"], r["new_value"]) for r in h] == [(None, "inactive"), ("inactive", "active")]
    k = mutate.value_history(events, g.nodes, "current_assessment").first()
    assert k["new_value"] == "weakly_supported"
    # A second batch sees the stored state as the previous one.
    again = ops(spark, op(0, "update_node", batch="b2", day=1, target_node_id=c["node_id"],
                          field_updates={"current_state": "disputed"}))
    events2, after2 = mutate.apply_batches(again, after)
    h2 = mutate.value_history(events2, after.nodes, "current_state").first()
    assert (h2["previous_value"], h2["new_value"]) == ("active", "disputed")
    assert after2.nodes.filter("node_type = 'condition'").first()["updated_at"] == T0 + timedelta(days=1)


def test_weight_changes_by_source(spark):
    g = mutate.empty_graph(spark)
    g.edges = spark.createDataFrame([("e", "x", "y", "causes", "weak", "f", False, T0, T0)], mutate.EDGE_SCHEMA)
    rows = [op(0, "update_edge_weight", target_edge_id="e", new_weight_band="strong", direction="strengthen"),
            op(1, "update_edge_weight", target_edge_id="e", new_weight_band="weak", direction="weaken"),
            op(2, "update_edge_weight", batch="b2", day=2, target_edge_id="e", new_weight_band="disputed",
               direction="weaken", **{"source": "disconfirmation"})]
    events, after = mutate.apply_batches(ops(spark, *rows), g)
    h = mutate.weight_history(events, g.edges).orderBy("content_timestamp", "pos").collect()
    assert [(r["previous_weight_band"], r["weight_band"], r["change_type"]) for r in h] == [
        ("weak", "strong", "strengthened"), ("strong", "weak", "weakened"), ("weak", "disputed", "disconfirmation")]
    assert after.edges.first()["current_weight_band"] == "disputed"


def sequential(rows):
    """Applies the operations one at a time, as the rules are written."""
    alias, nodes, edges, log = {}, {}, {}, {}
    batches = sorted({(r["batch_time"], r["batch_id"]) for r in rows})
    for _, b in batches:
        slugs = {}
        mine = [r for r in rows if r["batch_id"] == b]
        for r in sorted((r for r in mine if r["operation"] == "create_node"), key=lambda r: r["pos"]):
            name = r["fields"]["name"].strip()
            key = (b, 0, r["pos"])
            if not name:
                log[key] = "rejected"
                continue
            if name.lower() in alias:
                slugs[r["proposed_id"].lower()] = alias[name.lower()]
                log[key] = ("aliased", alias[name.lower()])
                continue
            nodes[key] = name
            slugs[r["proposed_id"].lower()] = key
            for a in [name] + (r["aliases"] or []):
                alias.setdefault(a.lower(), key)
            log[key] = ("made", key)
        for r in sorted((r for r in mine if r["operation"] == "create_edge"), key=lambda r: r["pos"]):
            s, t = slugs.get(r["source_ref"].lower()), slugs.get(r["target_ref"].lower())
            if s and t and s != t:
                edges[(b, 2, r["pos"])] = (s, t)
                log[(b, 2, r["pos"])] = "linked"
            else:
                log[(b, 2, r["pos"])] = "rejected"
    return nodes, edges, log


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    rows = []
    for b in range(4):
        for p in range(12):
            if rng.random() < 0.6:
                name = rng.choice(["", "A", "b", "C ", "D", "e", "F"])
                extra = rng.sample(["a", "B", "c", "d", "E", "f"], rng.choice([0, 0, 1, 2]))
                rows.append(node(p, f"s{rng.randrange(6)}", name, aliases=extra, batch=f"b{b}", day=b // 2))
            else:
                rows.append(edge(p, f"S{rng.randrange(6)}", f"s{rng.randrange(6)}", batch=f"b{b}", day=b // 2))
    nodes, edges, log = sequential(rows)
    events = mutate.validate(ops(spark, *rows), mutate.empty_graph(spark)).collect()
    made = {(r["batch_id"], r["phase"], r["pos"]): r["target_node"] for r in events
            if r["event_type"] == "create_node" and not r["rejected"]}
    assert set(made) == set(nodes)
    for r in events:
        key = (r["batch_id"], r["phase"], r["pos"])
        want = log[key]
        if want == "rejected":
            assert r["rejected"]
        elif want == "linked":
            assert (r["source_node_id"], r["target_of_edge"]) == tuple(made[k] for k in edges[key])
        else:
            assert r["event_type"] == {"made": "create_node", "aliased": "create_node_aliased"}[want[0]]
            assert r["target_node"] == made[want[1]]


def test_as_of_equals_fold_of_earlier_events(spark):
    from evgraph.operators.asof import value_as_of

    rng = random.Random(11)
    g = mutate.empty_graph(spark)
    g.edges = spark.createDataFrame([(f"e{i}", "x", "y", "causes", "weak", "f", False, T0, T0) for i in range(5)],
                                    mutate.EDGE_SCHEMA)
    rows = [op(p, "update_edge_weight", batch=f"b{d:02d}", day=d, target_edge_id=f"e{rng.randrange(5)}",
               new_weight_band=rng.choice(["strong", "weak", "moderate"]), direction="weaken")
            for d in range(10) for p in range(3)]
    events = mutate.validate(ops(spark, *rows), g)
    cut = T0 + timedelta(days=5)
    h = mutate.weight_history(events, g.edges).withColumn("id", F.col("pos"))
    as_of = {r["edge_id"]: r["weight_band"] for r in value_as_of(h, "edge_id", "weight_band", cut).collect()}
    early = events.filter(F.col("batch_time") <= F.lit(cut))
    fold = {r["edge_id"]: r["current_weight_band"] for r in mutate.fold_edges(early, g.edges).collect()}
    assert all(fold[k] == v for k, v in as_of.items()) and as_of


def test_resolve_names(spark):
    aliases = spark.createDataFrame([("Fed", "Federal Reserve", "n1"), ("Open", "O", None)], mutate.ALIAS_SCHEMA)
    d = spark.createDataFrame([(" FED ",), ("open",)], "n string")
    assert [(r["n"], r["canonical_node_id"]) for r in mutate.resolve_names(d, "n", aliases).collect()] == [(" FED ", "n1")]
