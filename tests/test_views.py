from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.plans import calibrate, changes, dimensions, market, reasoning, review, signals, topics

T = datetime(2024, 3, 1)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


NODE = "node_id string, node_type string, name string, description string, current_state string, created_at timestamp, updated_at timestamp"
EDGE = ("edge_id string, source_node_id string, target_node_id string, edge_type string, current_weight_band string, "
        "falsification_criteria string, last_disconfirmation_pass timestamp, deprecated boolean, created_at timestamp, updated_at timestamp")


def cond(i, name, state="active", days=100, desc=None, kind="condition"):
    return (i, kind, name, desc, state, T - timedelta(days=days), T - timedelta(days=days))


def link(i, a, b, band="strong", days=100, dep=False, crit="f", challenged=None):
    return (i, a, b, "causes", band, crit, challenged, dep, T - timedelta(days=days), T - timedelta(days=days))


@pytest.fixture
def world(spark):
    nodes = frame(spark, NODE, cond("o", "Oil export ban"), cond("b", "Bank credit stress", "inactive"),
                  cond("p", "Plain thing"), cond("z", "Late flood", days=-1), cond("v", "Pipeline fire", kind="event", days=0))
    edges = frame(spark, EDGE, link("e1", "o", "b"), link("e2", "b", "p", "weak"), link("e3", "o", "p", dep=True),
                  link("e4", "p", "o", "moderate", days=0), link("e5", "v", "o", "weak", days=0))
    hist = "id long, edge_id string, weight_band string, change_type string, content_timestamp timestamp"
    weights = frame(spark, hist, (1, "e1", "weak", "initial", T - timedelta(days=9)),
                    (2, "e1", "strong", "strengthened", T - timedelta(hours=24)),
                    (3, "e1", "moderate", "weakened", T), (4, "e3", "strong", "strengthened", T),
                    (5, "e2", "weak", "weakened", T), (6, "e1", "weak", "disconfirmation", T - timedelta(hours=1)),
                    (7, "e1", "weak", "strengthened", T + timedelta(seconds=1)))
    states = frame(spark, "id long, node_id string, new_state string, content_timestamp timestamp",
                   (1, "o", "inactive", T - timedelta(days=20)), (2, "o", "active", T - timedelta(hours=2)),
                   (3, "o", "active", T - timedelta(hours=1)), (4, "b", "inactive", T - timedelta(days=1)),
                   (5, "p", "disputed", T))
    topics_ = frame(spark, "topic_id string, node_id string", ("t1", "o"), ("t1", "b"), ("t2", "p"), ("t3", "b"))
    return nodes, edges, changes.with_previous(weights, "edge_id", "weight_band", "previous_weight_band"), \
        changes.with_previous(states, "node_id", "new_state", "previous_state"), topics_


def test_recent_changes(spark, world):
    nodes, edges, w, s, tn = world
    rows = changes.recent_changes(nodes, edges, w, s, tn, as_of=T).orderBy("impact_rank", "occurred_at", "change_id").collect()
    assert [r["change_id"] for r in rows] == ["ewh-6", "ewh-2", "ewh-3", "csh-2", "csh-4", "edge-new-e4"]
    first = rows[0]
    assert first["summary"] == "Disconfirmation weakened: Oil export ban causes Bank credit stress."
    assert (first["weight_before"], first["weight_after"]) == ("strong", "weak")
    assert first["dimension"] == "resource_availability" and first["downstream_edge_count"] == 3
    assert first["topic_ids"] == ["t1", "t3"]
    flip = rows[3]
    assert flip["summary"] == "Condition activated: Oil export ban." and flip["downstream_edge_count"] == 3
    assert rows[5]["summary"] == "New moderate link established: Plain thing causes Oil export ban."
    newest = changes.recent_changes(nodes, edges, w, s, as_of=T, limit=3, newest_first=True)
    assert newest.count() == 3


def test_new_event_touching_an_active_condition(spark, world):
    nodes, edges, *_ = world
    rows = changes.new_event_changes(nodes, edges, as_of=T).collect()
    assert [(r["change_id"], r["impact_rank"]) for r in rows] == [("event-new-v", 9)]


def test_notes_move_only_with_the_digest(spark, world):
    nodes, edges, w, s, _ = world
    ranked = changes.rank_changes(changes.change_stream(nodes, edges, w, s, as_of=T), 60)
    basis = changes.change_basis(ranked)
    hashes = {r["dimension"]: r["basis_hash"] for r in basis.collect()}
    cached = frame(spark, "dimension string, note string, basis_hash string, generated_at timestamp",
                   ("economic_stability", "kept", hashes["economic_stability"], T),
                   ("environmental_stress", "stale", "old", T), ("resource_availability", "older", "old", T))
    up = changes.note_updates(basis, cached)
    status = {r["dimension"]: r["status"] for r in up.collect()}
    assert status["economic_stability"] == "unchanged" and status["environmental_stress"] == "cleared"
    written = frame(spark, "dimension string, note string", ("resource_availability", "x" * 300))
    notes = {r["dimension"]: r for r in changes.apply_notes(up, cached, written, T).collect()}
    assert notes["economic_stability"]["note"] == "kept" and notes["environmental_stress"]["note"] == ""
    if status["resource_availability"] == "regenerate":
        assert len(notes["resource_availability"]["note"]) == 280


def test_dimension_scores(spark, world):
    nodes, edges, _, s, _ = world
    d = {r["dimension"]: r for r in dimensions.dimension_scores(nodes, edges, s, as_of=T).collect()}
    assert set(d) == set(vocab.DIMENSIONS)
    assert d["environmental_stress"]["state"] == "unknown" and d["environmental_stress"]["direction"] == "unknown"
    r = d["resource_availability"]
    assert (r["total_conditions"], r["active_conditions"], r["strong_edge_count"], r["weak_edge_count"]) == (1, 1, 2, 1)
    assert r["state"] == "crisis" and r["direction"] == "steady"
    past = {r["dimension"]: r for r in dimensions.dimension_scores(
        nodes, edges, s, as_of=T - timedelta(days=1), state_mode="as_of").collect()}
    assert past["resource_availability"]["active_conditions"] == 0


@pytest.mark.parametrize("shares,rate,label,accel", [
    ([0.5, 0.5], 0.0, "insufficient data", "—"),
    ([0.1, 0.2, 0.3], 0.1, "steep rising", "—"),
    ([0.5, 0.5, 0.5, 0.5], 0.0, "steady", "linear"),
    ([0.9, 0.5, 0.1, 0.15, 0.3, 0.5, 0.8], 0.06, "steep rising", "decelerating"),
])
def test_velocity(spark, shares, rate, label, accel):
    rows = [("structural_change", datetime(2024, 1, 1) + timedelta(days=7 * i), int(x * 100), 100) for i, x in enumerate(shares)]
    d = frame(spark, "dimension string, week_start timestamp, active_count long, total_count long", *rows)
    r = dimensions.velocity(d).filter("dimension = 'structural_change'").first()
    window = shares[-6:]
    n = len(window)
    if n >= 3:
        mx, my = (n - 1) / 2, sum(window) / n
        rate = round(sum((i - mx) * (y - my) for i, y in enumerate(window)) / sum((i - mx) ** 2 for i in range(n)), 4)
    assert r["rate"] == pytest.approx(rate) and r["rate_label"] == label
    if n < 6:
        assert r["accel_label"] == accel


def test_verdict(spark):
    d = frame(spark, "state string, direction string, strong_edge_count long, weak_edge_count long",
              ("crisis", "worsening", 1, 3), ("stable", "improving", 0, 0), ("unknown", "steady", 0, 0))
    r = dimensions.verdict(d).first()
    assert r["composite"] == pytest.approx(round((0.9 + 0.3 + 0.5) / 3, 6)) and r["headline"] == "Under pressure."
    assert r["subline"] == "1 stable, 1 crisis." and r["regime"] == "low, widening"
    e = frame(spark, "occurred_at timestamp", (T,), (T + timedelta(days=5),))
    assert [x["position"] for x in dimensions.track_position(e, T - timedelta(days=1), T + timedelta(days=1)).collect()] == [0.5]


@pytest.mark.parametrize("lat,lon,region", [
    (51.5, 0.1, "europe_west"), (60.0, 10.0, "nordic"), (-34.0, 18.5, "global"), (35.0, -10.0, "europe_west"),
    (71.5, 32.0, "nordic"), (90.0, 180.0, "global"), (80.0, 180.0, "russia"),
])
def test_regions(spark, lat, lon, region):
    p = frame(spark, "point_id int, lat double, lon double", (1, lat, lon))
    assert topics.region_of_points(p, vocab.regions(spark)).first()["region_id"] == region
    assert topics.region_of_points(p, vocab.regions(spark).filter(F.lit(False))).first()["region_id"] is None


def test_region_changes_by_keyword(spark):
    c = frame(spark, "change_id string, target_name string, summary string", ("c1", "OPEC cut", "x"), ("c2", "y", "z"))
    got = {}
    for r in topics.region_changes(c, vocab.regions(spark)).collect():
        got.setdefault(r["region_id"], set()).add(r["change_id"])
    assert got == {"middle_east": {"c1"}, "global": {"c1", "c2"}}


def test_topics(spark, world):
    nodes, edges, _, s, tn = world
    t = frame(spark, "topic_id string, name string", ("t1", "A"), ("t2", "B"), ("t9", "Empty"))
    d = {r["topic_id"]: r for r in topics.topic_list(t, tn, nodes, edges).collect()}
    assert (d["t1"]["node_count"], d["t1"]["active_condition_count"], d["t1"]["edge_count"]) == (2, 1, 1)
    assert d["t1"]["state"] == "strained" and d["t1"]["attention"] == "medium"
    assert d["t9"]["node_count"] == 0 and d["t9"]["state"] == "unknown"
    past = topics.topic_detail(t, tn, nodes, edges, as_of=T - timedelta(days=200)).filter("topic_id = 't1'").first()
    assert past["node_count"] == 0
    rel = topics.related_topics(tn).collect()
    assert [tuple(r) for r in rel] == [("t1", "t3", 1)]


def test_evidence_caps_and_keywords(spark, world):
    nodes, edges, w, *_ = world
    c, e, h = topics.evidence_bundle(nodes, edges, w, as_of=T)
    assert {(r["dimension"], r["node_id"]) for r in c.collect()} == {("resource_availability", "o")}
    assert {r["edge_id"] for r in e.collect()} == {"e1", "e4"}
    assert h.count() == 6
    assert "Oil export ban causes Bank credit stress — disconfirmed" in {r["summary"] for r in h.collect()}


def test_drilldowns(spark, world):
    nodes, edges, w, s, _ = world
    d = reasoning.node_drilldown(nodes, edges, s, nodes.filter("node_id = 'o'"), as_of=T)
    assert {r["edge_id"] for r in d["edges"].collect()} == {"e1", "e4", "e5"}
    assert {r["id"] for r in d["states"].collect()} == {1, 2, 3}


def test_challenge_selection(spark, world):
    nodes, *_ = world
    edges = frame(spark, EDGE, link("a", "o", "b", challenged=T - timedelta(days=8)), link("b", "o", "p"),
                  link("c", "o", "p", "moderate"), link("d", "o", "p", "weak"), link("e", "o", "p", crit=""),
                  link("f", "o", "p", dep=True), link("g", "o", "p", challenged=T - timedelta(days=6)))
    got = review.challenge_candidates(edges, nodes, now=T)
    order = [r["edge_id"] for r in got.collect()]
    assert set(order) == {"a", "b", "c"}
    assert [r["edge_id"] for r in review.challenge_candidates(edges, nodes, now=T, limit=1).collect()] == ["b"]
    assert review.inline_edges(edges, nodes).count() == 4
    sup = frame(spark, "edge_id string, signal_id long", ("a", 1), ("a", 2), ("c", 1))
    sig = frame(spark, "signal_id long, content_timestamp timestamp", (1, T - timedelta(days=40)), (2, T - timedelta(days=1)))
    stale = {r["edge_id"] for r in review.stale_support(edges, sup, sig, now=T).collect()}
    assert stale == {"b", "c", "e", "g"}


@pytest.mark.parametrize("mean,base,prior,want", [
    (1.0, 0.7, 0.5, 0.70), (-0.5, 0.7, 0.5, 0.5), (5.0, 0.9, 1.0, 0.95), (-9.0, 0.5, 0.0, 0.25), (0.0, 0.8, 0.8, 0.7067),
])
def test_new_weight(spark, mean, base, prior, want):
    w = spark.range(1).select(calibrate.new_weight(F.lit(mean), F.lit(base), F.lit(prior)).alias("w")).first()["w"]
    assert w == pytest.approx(want)


def test_sample_size():
    assert [calibrate.sample_size(n) for n in (0, 5, 100, 5000, 10 ** 6)] == [0, 5, 20, 100, 200]


def test_outcomes_and_report(spark):
    S = "signal_id long, payload_id long, source_id string, lens_id string, claim_text string, reasoning string, confidence_band string, content_timestamp timestamp, cluster_id string"
    rows = [(i, i, "src", "market", "claim", "fine", "inference", T - timedelta(days=i), "c" if i == 6 else None) for i in range(1, 8)]
    sig = frame(spark, S, *rows)
    ev = frame(spark, "event_id long, target_edge_id string, rejected boolean, applied_at timestamp",
               (1, "dead", False, T), (2, "up", False, T), (3, "down", False, T), (4, "flat", False, T),
               (5, "up", True, T), (6, "flat", False, T - timedelta(days=1)))
    tr = frame(spark, "event_id long, signal_id long", (1, 1), (2, 2), (6, 2), (3, 3), (4, 4), (5, 5))
    edges = frame(spark, "edge_id string, deprecated boolean", ("dead", True), ("up", False), ("down", False), ("flat", False))
    wh = frame(spark, "id long, edge_id string, change_type string, content_timestamp timestamp",
               (1, "up", "strengthened", T), (2, "up", "weakened", T), (3, "down", "disconfirmation", T),
               *[(10 + i, "flat", "initial", T + timedelta(days=i)) for i in range(5)], (9, "flat", "strengthened", T - timedelta(days=1)))
    lost = frame(spark, "signal_id long, source_id string, lens_id string, content_timestamp timestamp",
                 (99, "src", "market", T - timedelta(days=3)), (98, "src", "market", T + timedelta(days=3)))
    tracked = calibrate.register(None, sig.select("signal_id", "source_id", "lens_id", "content_timestamp").unionAll(lost), "r")
    assert calibrate.register(tracked, sig, "r").count() == 0
    tables = dict(signals=sig, events=ev, triggers=tr, edges=edges, weight_history=wh)
    done = calibrate.resolve(tracked, cutoff=T, **tables)
    got = {r["signal_id"]: r["outcome"] for r in done.collect()}
    assert got == {1: "anchored_deprecated", 2: "anchored_strengthened", 3: "anchored_weakened", 4: "anchored_persistent",
                   5: "isolated_in_tier_a", 6: "clustered_but_not_anchored", 7: "isolated_in_tier_a",
                   99: "extraction_rejected", 98: "pending"}
    some = calibrate.resolve(tracked, cutoff=T, batch_size=2, **tables)
    assert {r["signal_id"] for r in some.filter("outcome <> 'pending'").collect()} == {7, 6}
    reg = frame(spark, "source_id string, tier string, starting_source_weight double, access_method string", ("src", "1", 0.2, "rss"))
    s = calibrate.source_scores(done, reg).first()
    assert s["n_signals"] == 8 and s["raw_score"] == pytest.approx(-0.4) and s["flagged"]
    unknown = calibrate.source_scores(done, reg.filter("source_id = 'x'")).first()
    assert (unknown["tier"], unknown["prior_weight"], unknown["tier_baseline"]) == ("3", 0.5, 0.5)
    import json

    r = json.loads(calibrate.report(done, sig, reg, window_end=T).first()["report"])
    assert r["n_total"] == 9 and r["flagged_sources"] == ["src"] and r["sources"][0]["breakdown"]["isolated_in_tier_a"] == 2
    w = calibrate.apply_weights(calibrate.source_scores(done, reg), "r", now=T, sources=["src"])
    assert w.count() == 1 and calibrate.apply_weights(calibrate.source_scores(done, reg), "r", now=T, sources=[]).count() == 0


def test_calibration_run(spark):
    p = frame(spark, "payload_id long, source_id string, content_timestamp timestamp, rejected boolean",
              (1, "src", T, False), (2, "src", T, True), (3, "src", T + timedelta(days=9), False), (4, "other", T, False))
    extract = lambda d: d.select(
        F.col("payload_id").alias("signal_id"), "payload_id", "source_id", F.lit("market").alias("lens_id"),
        F.lit("c").alias("claim_text"), F.lit("since 2031").alias("reasoning"), F.lit("inference").alias("confidence_band"),
        "content_timestamp", F.lit(None).cast("string").alias("cluster_id"))
    none = lambda s: spark.createDataFrame([], s)
    reg = frame(spark, "source_id string, tier string, starting_source_weight double, access_method string", ("src", "1", 0.2, "api"))
    done, rep = calibrate.execute_run(
        p, extract, run_id="r", window_start=T - timedelta(days=1), window_end=T, registry=reg, sources=["src"],
        events=none("event_id long, target_edge_id string, rejected boolean, applied_at timestamp"),
        triggers=none("event_id long, signal_id long"), edges=none("edge_id string, deprecated boolean"),
        weight_history=none("id long, edge_id string, change_type string, content_timestamp timestamp"))
    assert [(r["signal_id"], r["outcome"]) for r in done.collect()] == [(1, "isolated_in_tier_a")]
    assert '"n_suspicious":1' in rep.first()["report"]


@pytest.mark.parametrize("reasoning,claim,band,source,method,bad", [
    ("in 2031 it rose", "", "inference", "s", "api", True), ("", "target 2031", "inference", "s", "api", True),
    ("", "in 2020", "inference", "s", "api", False), ("As of 1999", "", "inference", "s", "api", True),
    ("has since recovered", "", "inference", "s", "api", True), ("", "", "hard_datum", "my_RSS_feed", "api", True),
    ("", "", "hard_datum", "s", "rss", True), ("", "", "hard_datum", "s", None, False), (None, None, None, None, None, False),
])
def test_suspicion(spark, reasoning, claim, band, source, method, bad):
    d = frame(spark, "reasoning string, claim_text string, confidence_band string, source_id string, access_method string",
              (reasoning, claim, band, source, method))
    assert d.select(calibrate.suspicious(2024).alias("x")).first()["x"] is bad


def test_weights_versions(spark):
    o = frame(spark, "override_id long, source_id string, weight double, applied_at timestamp",
              (1, "a", 0.4, T), (2, "a", 0.6, T + timedelta(days=1)), (3, "b", 0.9, T))
    v = {r["override_id"]: r["superseded_at"] for r in calibrate.weight_versions(o).collect()}
    assert v == {1: T + timedelta(days=1), 2: None, 3: None}
    reg = frame(spark, "source_id string, starting_source_weight double", ("a", 0.5), ("c", 0.7))
    e = {r["source_id"]: (r["effective_weight"], r["weight_delta"]) for r in calibrate.effective_weights(reg, o).collect()}
    assert e == {"a": (0.6, 0.1), "c": (0.7, 0.0)}
    assert calibrate.override_history(o, 1).filter("source_id = 'a'").first()["override_id"] == 2


def test_moves(spark):
    def move(values, window):
        d = frame(spark, "symbol string, ts timestamp, close double",
                  *[("s", T + timedelta(days=i), float(v)) for i, v in enumerate(values)])
        r = market.move_by_count(d, window).collect()
        return (r[0]["latest"], r[0]["prior"], round(r[0]["pct_change"], 6), r[0]["used_window"]) if r else None

    assert move([100, 101, 102, 103, 104, 105], 5) == (105.0, 100.0, 5.0, 5)
    assert move([100, 110], 5) == (110.0, 100.0, 10.0, 1)
    assert move([100], 5) is None and move([0, 5], 5) is None and move([1, 2], 0) is None
    obs = lambda *r: frame(spark, "symbol string, ts timestamp, value double", *[("s", T - timedelta(days=d), v) for d, v in r])
    r = market.move_by_days(obs((0, 110.0), (3, 105.0), (5, 100.0), (30, 1.0)), 5).first()
    assert (r["prior"], round(r["pct_change"], 6)) == (100.0, 10.0)
    assert market.move_by_days(obs((0, 2.0), (1, 1.0)), 5).first()["prior"] == 1.0
    s = market.move_by_days(obs((0, 82.4), (5, 80.0)), 5).select(market.days_sentence(F.lit("WTI")).alias("t")).first()["t"]
    assert s == "Market move: WTI (s) rose +3.00% between 2024-02-25 and 2024-03-01, 80 → 82.4."
    cls = [spark.range(1).select(market.instrument_class(F.lit(x)).alias("c")).first()["c"]
           for x in ("DCOILWTICO", "DEXUSEU", "SP500", "VIXCLS", "IRLTLT01DEM156N", "PPIACO")]
    assert cls == ["commodity", "currency", "equity_index", "volatility", "bond_yield", ""]
    a = frame(spark, "symbol string, pct_change double", ("x", 1.0), ("y", 1.0))
    b = frame(spark, "symbol string, pct_change double", ("X", 1.3), ("Y", 2.0))
    pairs = frame(spark, "symbol_a string, symbol_b string", ("x", "X"), ("y", "Y"))
    assert {r["symbol_a"]: r["verdict"] for r in market.corroborate(a, b, pairs).collect()} == {"x": "agree", "y": "diverge"}


def test_signal_reads(spark):
    d = frame(spark, "signal_id long, payload_id long, lens_id string, anchored boolean, extracted_at timestamp, content_timestamp timestamp",
              (1, 1, "a", False, T - timedelta(hours=2), T), (2, 1, "b", True, T - timedelta(hours=2), T),
              (3, 2, "a", False, T - timedelta(minutes=30), T), (4, 9, "b", False, T - timedelta(days=91), T - timedelta(days=91)))
    assert {r["signal_id"] for r in signals.unanchored(d, now=T).collect()} == {1, 4}
    assert {r["signal_id"] for r in signals.unanchored(d, now=T, lens_id="b", limit=None).collect()} == {4}
    p = frame(spark, "payload_id long, source_id string", (1, "x"), (2, "y"))
    assert [r["signal_id"] for r in signals.recent(d, p, source_id="x").collect()] == [1, 2]
    cite = {r["signal_id"]: r["source_id"] for r in signals.with_citation(d, p).collect()}
    assert cite == {1: "x", 2: "x", 3: "y", 4: None}
    hot, old = signals.archive_split(d, now=T)
    assert [r["signal_id"] for r in old.collect()] == [4] and hot.count() == 3
    k = d.withColumn("signal_kind", F.when(F.col("signal_id") == 4, "inventory_level").otherwise("structural"))
    w = {r["signal_id"]: r["remaining_weight"] for r in signals.decayed(k, now=T).collect()}
    assert w[1] == 1.0 and w[4] == pytest.approx(0.5 ** (91 / 90))
