from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evgraph.operators import quality

NOW = datetime(2024, 1, 10)
SCHEMA = "arrival long, source_id string, url string, content string, fetched_at timestamp"
GOOD = "A perfectly ordinary paragraph about shipping lanes that is long enough to be kept by rule one."


def run(spark, contents, stored=None):
    rows = [(i, s, f"u{i}", c, NOW) for i, (s, c) in enumerate(contents)]
    d = quality.check_run(spark.createDataFrame(rows, SCHEMA), stored, now=NOW)
    return {r["arrival"]: r["rejected_reason"] for r in d.collect()}


def test_rules_in_order(spark):
    link = "http://example.com/" + "a" * 90 + " and some words here"
    got = run(spark, [
        ("s", "short"), ("s", GOOD), ("s", link), ("s", GOOD + " Please SUBSCRIBE to our newsletter."),
        ("s", "privacy policy"),
    ])
    assert got[0] == "content too short (5 chars < 80)"
    assert got[1] is None
    assert got[2] == f"link density too high (109/{len(link)})"
    assert got[3] == "SEO/noise phrase detected: 'subscribe to our newsletter'"
    assert got[4] == "content too short (14 chars < 80)"


def test_only_accepted_rows_are_remembered_within_a_run(spark):
    noise = GOOD + " All rights reserved."
    got = run(spark, [("s", GOOD), ("s", GOOD), ("other", GOOD), ("s", noise), ("s", noise)])
    dup = "exact duplicate of already-ingested content"
    assert got[0] is None and got[1] == dup and got[2] is None
    assert got[3] == got[4] == "SEO/noise phrase detected: 'all rights reserved'"


def test_stored_content_is_known_for_seven_days(spark):
    def stored(days):
        return spark.createDataFrame(
            [("s", GOOD, NOW - timedelta(days=days))], "source_id string, content string, fetched_at timestamp")

    assert run(spark, [("s", GOOD)], stored(6))[0] is not None
    assert run(spark, [("s", GOOD)], stored(8))[0] is None


def test_normalise(spark):
    d = spark.createDataFrame(
        [("s", "u", GOOD, NOW, None, {"content_hash": "short", "a": "b"})],
        "source_id string, url string, content string, fetched_at timestamp, "
        "content_timestamp timestamp, metadata map<string,string>")
    r = quality.normalise(d).first()
    assert len(r["metadata"]["content_hash"]) == 64 and r["metadata"]["a"] == "b"
    assert r["content_timestamp"] == NOW


def test_claims(spark):
    d = spark.createDataFrame(
        [(1, "p", "a", "Oil up"), (2, "p", "b", " oil UP "), (3, "p", "b", "gas"), (4, "q", "b", "oil up")],
        "signal_id long, payload_id string, lens_id string, claim_text string")
    kept = {r[0] for r in quality.dedup_claims(d, ["payload_id"], ["signal_id"]).select("signal_id").collect()}
    assert kept == {1, 3, 4}
    found = quality.convergence(d).collect()
    assert len(found) == 1 and found[0]["n_signals"] == 3 and found[0]["n_distinct"] == 2
    assert {r[0] for r in quality.convergent_signals(d).select("signal_id").collect()} == {1, 2, 4}


def test_copies_of_one_text_shuffle_without_the_text(spark):
    d = spark.createDataFrame([(i, "s", "u", GOOD, NOW) for i in range(50)], SCHEMA)
    out = quality.check_run(d, None, now=NOW)
    assert out.filter("rejected_reason IS NULL").count() == 1
    plan = out.groupBy("rejected_reason").agg(F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
