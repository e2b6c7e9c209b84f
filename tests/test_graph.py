import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evgraph.operators import components, traverse, vectors

T0 = datetime(2024, 1, 1)


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 80)] + [(100, 101)],
    [(random.Random(s).randrange(90), random.Random(s + 500).randrange(90)) for s in range(70)],
])
def test_components_equal_union_find(spark, pairs):
    got = {r["node"]: r["root"] for r in components.components(
        spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == union_find(pairs)


def _signals(spark, rows):
    data = [(i, f"lens{i % 2}", T0 + timedelta(minutes=i), T0 + timedelta(hours=h)) for i, h in rows]
    return spark.createDataFrame(data, "signal_id long, lens_id string, content_timestamp timestamp, extracted_at timestamp")


def test_shared_names_chain_signals(spark):
    s = _signals(spark, [(1, 0), (2, 0), (3, 0), (4, 0)])
    e = spark.createDataFrame([(1, "Oil"), (2, " oil "), (2, "OPEC"), (3, "opec"), (3, "Russia"), (9, "x")],
                              "signal_id long, name string")
    got = {r["signal_id"]: r["group_id"] for r in components.group_signals(s, e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_windows_of_twenty_and_hold_back(spark):
    s = _signals(spark, [(i, 0) for i in range(25)] + [(90, 0), (91, 5)])
    e = spark.createDataFrame([(i, "one") for i in range(25)], "signal_id long, name string")
    g = components.group_signals(s, e)
    now = T0 + timedelta(hours=7)

    def sizes(**kw):
        b = components.batch_summary(components.form_batches(g, now=now, **kw))
        return sorted(r["n_signals"] for r in b.collect())

    assert sizes() == [5, 20]
    assert sizes(max_hold_hours=6.0) == [1, 5, 20]
    assert sizes(force=True) == [1, 1, 5, 20]
    newest = components.form_batches(g, now=now).filter("batch_no = 1").agg(F.max("signal_id")).first()[0]
    assert newest == 4


def _edges(spark, rows):
    return spark.createDataFrame(
        [(i, a, b, d, "strong", "f") for i, (a, b, d) in enumerate(rows)],
        "edge_id long, source_node_id string, target_node_id string, deprecated boolean, "
        "current_weight_band string, falsification_criteria string")


def test_blast_radius_equals_the_count_of_other_edges(spark):
    rng = random.Random(3)
    rows = []
    while len(rows) < 120:
        a, b = rng.choice("hhhabcdefg"), rng.choice("abcdefg")
        if a != b:
            rows.append((a, b, rng.random() < 0.2))
    got = {r["edge_id"]: r["blast_radius"] for r in traverse.blast_radius(_edges(spark, rows)).collect()}
    for i, (a, b, _) in enumerate(rows):
        want = sum(1 for j, (c, d, dep) in enumerate(rows) if j != i and not dep and {a, b} & {c, d})
        assert got[i] == want


def test_neighbourhood_expands_to_one_less_than_the_depth(spark):
    e = _edges(spark, [("a", "b", False), ("c", "b", False), ("c", "d", False), ("a", "z", True)])
    roots = spark.createDataFrame([("a",), ("d",)], "root string")
    nodes, found = traverse.neighbourhood(e, roots, depth=2)
    assert {tuple(r) for r in nodes.collect()} == {("a", "a", 0), ("a", "b", 1), ("d", "d", 0), ("d", "c", 1)}
    assert {tuple(r) for r in found.collect()} == {("a", 0), ("a", 1), ("d", 2), ("d", 1)}


def test_pack_keeps_the_line_that_crosses(spark):
    d = spark.createDataFrame([("k", i, "x" * 9) for i in range(5)], "k string, o int, line string")
    got = traverse.pack_lines(d, key="k", order=["o"], bucket=F.floor(F.col("o") / 2), budget=20).collect()
    assert sorted(r["o"] for r in got) == [0, 1, 2]


def test_context_roots_stop_at_the_limit(spark):
    names = spark.createDataFrame([("b", i, f"n{i}") for i in range(6)], "batch_id string, name_no long, name string")
    hits = spark.createDataFrame([(f"n{i}", f"x{i}{j}", 1.0 - j / 10) for i in range(6) for j in range(3)],
                                 "name string, node_id string, score double")
    got = traverse.context_roots(names, hits, limit=3).collect()
    assert sorted(r["node_id"] for r in got) == ["x00", "x01", "x10", "x11"]


def test_paths_multiply_and_flag(spark):
    e = spark.createDataFrame(
        [("1", "a", "b", False, "strong", "f1"), ("2", "b", "c", False, "moderate", ""),
         ("3", "c", "a", False, "weak", "f3"), ("4", "b", "d", False, "disputed", "f4")],
        "edge_id string, source_node_id string, target_node_id string, deprecated boolean, "
        "current_weight_band string, falsification_criteria string")
    got = {"".join(r["path"]): r for r in traverse.projection_paths(
        e, spark.createDataFrame([("a",)], "node_id string")).collect()}
    assert set(got) == {"ab", "abc", "abd"}
    assert float(got["abc"]["strength"]) == pytest.approx(0.48) and float(got["abc"]["weakest"]) == 0.6
    assert got["abd"]["disputed"] and float(got["abd"]["strength"]) == pytest.approx(0.8)
    assert got["abd"]["falsifiers"] == ["f1", "f4"]


def test_walk_totals_equal_the_listed_walks(spark):
    import random

    random.seed(3)
    bands = ["strong", "moderate", "weak", "provisional", "disputed"]
    rows = []
    for i in range(90):
        a, b = random.choice("abcdefgh"), random.choice("abcdefgh")  # loops, parallel edges and two-way pairs
        rows.append((str(i), a, b, i % 9 == 0, random.choice(bands), random.choice(["", "f"])))
    rows += [("x", "p", "q", False, "disputed", ""), ("y", "q", "p", False, "weak", ""), ("z", "q", "r", False, "disputed", "f")]
    e = spark.createDataFrame(rows, "edge_id string, source_node_id string, target_node_id string, deprecated boolean, "
                              "current_weight_band string, falsification_criteria string")
    starts = spark.createDataFrame([(n,) for n in "abcpqz"], "node_id string")
    listed = traverse.projection_paths(e, starts, depth=3).groupBy("start", "hops").agg(
        F.count(F.lit(1)).alias("n_paths"), F.countDistinct("end").alias("n_ends"), F.max("strength").cast("double").alias("best"),
        F.sum("strength").cast("double").alias("total"), F.min("weakest").cast("double").alias("weakest"),
        F.count_if("disputed").alias("n_disputed"), F.sum(F.size("falsifiers")).alias("n_falsifiers"))
    for depth in (1, 2, 3):
        got = traverse.projection_totals(e, starts, depth).collect()
        want = listed.filter(F.col("hops") <= depth).collect()
        plain = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
        assert sorted(map(plain, got), key=str) == sorted(map(plain, want), key=str)
    assert traverse.projection_totals(e.limit(0), starts).count() == 0


def test_reference_cycles(spark):
    d = spark.createDataFrame([("x", "a", "b"), ("x", "b", "c"), ("x", "c", "a"), ("y", "a", "b"), ("y", "b", "c")],
                              "batch_id string, source_ref string, target_ref string")
    assert {tuple(r) for r in traverse.reference_cycles(d).collect()} == {("x", "a"), ("x", "b"), ("x", "c")}


@pytest.mark.parametrize("above,block", [(0.92, 2000), (0.92, 7), (0.5, 11)])
def test_vector_clusters_equal_all_pairs(spark, above, block, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(120):
        v = centres[i % 6] + rng.normal(size=8) * 0.25 if i % 3 else centres[0]
        rows.append((i, i % 2, [float(x) for x in v]))
    d = spark.createDataFrame(rows, "signal_id long, lens_no int, vector array<double>")
    got = {r["signal_id"]: r["cluster_id"] for r in vectors.cluster_vectors(d, above=above).collect()}
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    pairs = [(i, i) for i in range(120)] + [
        (i, j) for i in range(120) for j in range(i) if rows[i][1] == rows[j][1] and c[i, j] > above]
    assert got == union_find(pairs)


def test_cycles_do_not_include_what_joins_them(spark):
    refs = [("x", a, b) for a, b in ["ab", "ba", "bc", "cd", "de", "ed", "fa", "eg"]]
    refs += [("y", "p", "q"), ("y", "q", "r"), ("z", "s", "s"), ("z", "s", "t"), ("z", "t", "u")]
    refs += [("w", a, b) for a, b in ["ab", "bc", "ca", "cd", "de", "ef", "fd"]]
    d = spark.createDataFrame(refs, "batch_id string, source_ref string, target_ref string")
    got = {(r.batch_id, r.slug) for r in traverse.reference_cycles(d).collect()}
    want = {("x", c) for c in "abde"} | {("z", "s")} | {("w", c) for c in "abcdef"}
    assert got == want
