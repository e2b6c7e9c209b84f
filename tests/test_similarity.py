import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evgraph.operators import similarity
from evgraph.plans import topics


def grams(s):
    out = set()
    for w in re.findall(r"\w+", s.lower()):
        p = f"  {w} "
        out |= {p[i:i + 3] for i in range(len(w) + 1)}
    return out


def ratio(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 0.0


WORDS = ["oil", "export", "supply", "market", "bank", "credit", "ring", "red", "bolt", "stress", "river"]


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(1, 4))) + (f" {rng.randrange(30)}" if rng.random() < .5 else "")
            for _ in range(n)]


@pytest.mark.parametrize("above", [0.1, 0.3, 0.5, 0.75])
@pytest.mark.parametrize("broadcast", [True, False])
def test_similar_texts_equal_brute_force(spark, above, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(similarity, "BROADCAST_GRAMS", -1)
    a, b = sorted(set(texts(40, 1))), sorted(set(texts(50, 2)))
    left = spark.createDataFrame([(x,) for x in a + a], "x string")
    right = spark.createDataFrame([(x,) for x in b], "y string")
    got = {(r[0], r[1]): r[2] for r in similarity.similar_texts(left, "x", right, "y", above).collect()}
    want = {(x, y): ratio(x, y) for x in a for y in b if ratio(x, y) > above}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("k", [1, 4, 25])
def test_top_similar_equals_brute_force(spark, k):
    q = sorted(set(texts(15, 3)))
    items = [(f"n{i:03d}", t) for i, t in enumerate(texts(120, 4))]
    d = similarity.search_names(
        spark.createDataFrame([(x,) for x in q], "q string"), "q",
        spark.createDataFrame(items, "node_id string, name string"), k=k)
    got = {}
    for r in d.collect():
        got.setdefault(r["query"], set()).add(r["node_id"])
    for x in q:
        best = sorted(((-ratio(x, t), i) for i, t in items if ratio(x, t) > 0.1))[:k]
        assert got.get(x, set()) == {i for _, i in best}


def test_one_name_held_by_a_third_of_all_items(spark):
    items = [(f"n{i:04d}", "oil export" if i % 3 == 0 else f"other {i}") for i in range(900)]
    d = similarity.search_names(
        spark.createDataFrame([("oil export",)], "q string"), "q",
        spark.createDataFrame(items, "node_id string, name string"), k=5)
    assert sorted(r["node_id"] for r in d.collect()) == ["n0000", "n0003", "n0006", "n0009", "n0012"]


def test_alias_candidates(spark):
    aliases = spark.createDataFrame(
        [("Reserve Bank", "RB", "n1"), ("Reserve Banks", "RB", "n1"), ("River", "R", None), ("Reserve", "X", "n2")],
        "alias_text string, canonical_name string, canonical_node_id string")
    d = similarity.alias_candidates(spark.createDataFrame([("reserve bank",)], "n string"), "n", aliases)
    assert {r["alias_text"]: round(r["score"], 3) for r in d.collect()} == {
        "Reserve Bank": 1.0, "Reserve Banks": round(ratio("reserve bank", "Reserve Banks"), 3),
        "Reserve": round(ratio("reserve bank", "Reserve"), 3)}


def test_containing_equals_brute_force(spark):
    docs = texts(60, 5) + ["OIL up", "a", ""]
    terms = ["oil", "OI", "o", "red bolt", "bank credit", "zzz", "a", "stress 1"]
    d = similarity.containing(
        spark.createDataFrame([(x,) for x in docs], "t string"), "t",
        spark.createDataFrame([(x,) for x in terms], "w string"), "w")
    assert {tuple(r) for r in d.collect()} == {
        (t, w) for t in docs for w in terms if w.lower() in t.lower()}


def test_signals_near_edges_equal_brute_force(spark):
    t0 = datetime(2024, 1, 1)
    sig = [(i, t, t0 + timedelta(hours=i % 50)) for i, t in enumerate(texts(150, 6))]
    edges = [(f"e{i}", a, b) for i, (a, b) in enumerate(zip(texts(20, 7), texts(20, 8)))]
    d = similarity.signals_near_edges(
        spark.createDataFrame(edges, "edge_id string, source_name string, target_name string"),
        spark.createDataFrame(sig, "signal_id long, claim_text string, content_timestamp timestamp"), k=6)
    got = {}
    for r in d.collect():
        got.setdefault(r["edge_id"], set()).add(r["signal_id"])
    for e, a, b in edges:
        near = [(ts, i) for i, t, ts in sig if ratio(t, a) > 0.15 or ratio(t, b) > 0.15]
        assert got.get(e, set()) == {i for _, i in sorted(near, reverse=True)[:6]}


def test_question_keeps_a_name_with_the_start_of_the_question(spark):
    long = "x " * 60 + "why rain"
    nodes = spark.createDataFrame([("a", long, None), ("b", "unrelated", "why rain")],
                                  "node_id string, name string, description string")
    q = spark.createDataFrame([("why rain",)], "question string")
    got = {r["node_id"]: r["score"] for r in topics.question_nodes(q, nodes).collect()}
    assert set(got) == {"a", "b"} and got["b"] == 1.0
    assert got["a"] == pytest.approx(ratio(long, "why rain"))
    low = spark.createDataFrame([("c", " ".join(f"word{i}" for i in range(40)) + " why", None)],
                                "node_id string, name string, description string")
    got = topics.question_nodes(spark.createDataFrame([("why",)], "question string"), low).collect()
    assert [r["node_id"] for r in got] == ["c"] and 0 < got[0]["score"] < 0.1


def test_condition_overview_needs_a_dimension(spark):
    d = spark.createDataFrame(
        [("condition", "x", "active", datetime(2024, 1, 1)), ("condition", None, "active", datetime(2024, 1, 1)),
         ("event", "x", "active", datetime(2024, 1, 1)), ("condition", "x", "unknown", datetime(2024, 1, 1))],
        "node_type string, dimension string, current_state string, created_at timestamp")
    assert [tuple(r) for r in topics.condition_overview(d, datetime(2024, 2, 1)).collect()] == [("x", 2, 1)]
    assert topics.condition_overview(d, datetime(2023, 2, 1)).agg(F.count("*")).first()[0] == 0
