import json
from datetime import datetime

from evgraph import vocab
from evgraph.sources import landed, seeds

AT = datetime(2024, 1, 2, 3, 4, 5)


def test_registry_defaults(spark, folder):
    with open(f"{folder}/r.jsonl", "w") as f:
        f.write(json.dumps({"source_id": "a", "canonical_name": "A", "url_base": "${HOST}/x-$HOST-$NOPE"}) + "\n")
        f.write(json.dumps({"source_id": "b", "canonical_name": "B", "enabled": False, "tier": "1"}) + "\n")
    raw = spark.read.schema(landed.REGISTRY_SCHEMA).json(f"{folder}/r.jsonl")
    d = {r["source_id"]: r for r in landed.registry_defaults(raw, {"HOST": "h"}).collect()}
    assert d["a"]["url_base"] == "h/x-h-$NOPE"
    assert (d["a"]["tier"], d["a"]["perspective"], d["a"]["languages"]) == ("2", "us_eu", ["en"])
    assert (d["a"]["access_method"], d["a"]["starting_source_weight"], d["a"]["enabled"]) == ("rss", 0.5, True)
    assert d["b"]["tier"] == "1" and not d["b"]["enabled"]
    counts = landed.source_counts(landed.load_registry(spark, f"{folder}/r.jsonl")).first()
    assert tuple(counts) == (1, 2)


def _sources(spark):
    return spark.createDataFrame([("s", "india", ["fr", "en"])],
                                 "source_id string, perspective string, languages array<string>")


def test_feed_entries(spark):
    items = "".join(f"<item><title>T{i}</title><link>http://x/{i}</link></item>" for i in range(60))
    xml = f"""<rss><channel><title>feed</title>
      <item><title>First</title><description>Body</description><link>http://x/a</link>
        <pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>
      <item><title>Second</title><content>Long</content><updated>2024-01-03T00:00:00Z</updated></item>
      <item><title> </title></item>{items}</channel></rss>"""
    feeds = spark.createDataFrame([("s", "http://feed", "lab", AT, xml)],
                                  "source_id string, feed_url string, feed_label string, fetched_at timestamp, body string")
    rows = landed.feed_entries(feeds, _sources(spark)).collect()
    by = {r["metadata"]["headline"]: r for r in rows}
    assert len(rows) == 49
    assert by["First"]["content"] == "First\n\nBody" and by["First"]["content_timestamp"] == AT
    assert by["Second"]["content"] == "Second\n\nLong" and by["Second"]["url"] == "http://feed"
    assert by["Second"]["content_timestamp"] == datetime(2024, 1, 3)
    assert by["T0"]["content_timestamp"] == AT and by["T0"]["language"] == "fr"
    assert "T47" not in by


def test_page_rows(spark):
    d = spark.createDataFrame(
        [("s", "us_eu", "http://x", "body", 200, AT, None, "DE-at, en", "Mon, 01 Jan 2024 10:00:00 EST", None),
         ("s", "us_eu", "http://y", "body", 200, AT, None, None, None, "bad date")],
        "source_id string, perspective string, url string, body string, status_code int, fetched_at timestamp, "
        "language string, content_language string, last_modified string, date string")
    a, b = sorted(landed.page_rows(d).collect(), key=lambda r: r["url"])
    assert a["language"] == "de" and a["content_timestamp"] == datetime(2024, 1, 1, 10)
    assert b["language"] == "en" and b["content_timestamp"] == AT


def test_search_results(spark):
    body = json.dumps({"results": [{"title": "T", "content": "S", "url": "u", "engine": "e",
                                    "publishedDate": "Tue, 02 Jan 2024 03:04:05 +0100"},
                                   {"title": "", "content": ""}] + [{"title": f"n{i}"} for i in range(20)]})
    d = spark.createDataFrame([("s", "us_eu", "q", AT, body)],
                              "source_id string, perspective string, query string, fetched_at timestamp, body string")
    rows = landed.search_results(d).collect()
    assert len(rows) == 9
    assert rows[0]["content"] == "T\n\nS" and rows[0]["content_timestamp"] == datetime(2024, 1, 2, 2, 4, 5)


def _quake(spark, *features):
    return spark.createDataFrame([("s", "us_eu", "req", AT, json.dumps({"features": list(features)}))],
                                 "source_id string, perspective string, request_url string, fetched_at timestamp, body string")


def test_quakes(spark):
    d = _quake(spark,
               {"id": "i1", "geometry": {"coordinates": [10.5, 20.25, 33.0]},
                "properties": {"mag": 5.16, "place": "P", "time": 1704164645000, "magType": "mb", "url": "u"}},
               {"id": "i2", "properties": {"mag": None}},
               {"id": "i3", "geometry": {"coordinates": [1.0, 2.0]}, "properties": {"mag": 4.0}})
    a, b = landed.quakes_ms(d).collect()
    assert a["content"] == ("USGS Earthquake: mb5.2 — P\nTime: 2024-01-02T03:04:05+00:00\nDepth: 33.0 km\n"
                            "Coordinates: 20.250°N, 10.500°E\n")
    assert a["content_timestamp"] == AT and a["url"] == "u"
    assert b["content"] == "USGS Earthquake: M4.0 — unknown location\nTime: unknown\n" and b["url"] == "req"

    d = _quake(spark,
               {"id": "x", "geometry": {"coordinates": [10.5, 20.256]},
                "properties": {"mag": 5.1, "flynn_region": "", "place": "Q", "time": "2024-01-02T03:04:05Z",
                               "depth": 10, "unid": "n"}},
               {"properties": {"mag": 0}}, {"properties": {}},
               {"id": "y", "geometry": {}, "properties": {"mag": 3.0, "time": 1704164645000}})
    a, b = landed.quakes_iso(d).collect()
    assert a["content"] == ("Earthquake detected: M5.1 Q. Depth: 10 km. Coordinates: 20.26N, 10.50E. "
                            "Event ID: n. Time: 2024-01-02T03:04:05Z.")
    assert a["content_timestamp"] == b["content_timestamp"] == AT
    assert b["content"] == "Earthquake detected: M3.0 Unknown region. Depth: None km."


def test_observations_and_charts(spark):
    body = json.dumps({"observations": [{"date": "2024-01-02", "value": "1.5"}, {"date": "2024-01-01", "value": "."}]})
    d = spark.createDataFrame([("DGS10", body)], "series_id string, body string")
    assert [tuple(r) for r in landed.observations(d).collect()] == [("DGS10", datetime(2024, 1, 2), 1.5)]
    chart = json.dumps({"chart": {"result": [{"timestamp": [1704164645, 1704251045, 1704337445],
                                              "indicators": {"quote": [{"close": [1.0, None, 3.0]}]}}]}})
    d = spark.createDataFrame([("X", chart), ("Y", '{"chart": {}}'), ("Z", "no")], "symbol string, body string")
    rows = landed.chart_closes(d).orderBy("pos").collect()
    assert [(r["symbol"], r["close"]) for r in rows] == [("X", 1.0), ("X", 3.0)]
    assert rows[0]["last_ts"] == datetime(2024, 1, 4, 3, 4, 5)


def test_dispatch_keeps_enabled_sources(spark):
    row = [("s", "u", "p", "c", AT, AT, "t", "en", {"a": "b"}), ("t", "u", "p", "c", AT, AT, "t", "en", {})]
    d = spark.createDataFrame(row, "source_id string, url string, perspective string, content string, "
                              "fetched_at timestamp, content_timestamp timestamp, content_type string, "
                              "language string, metadata map<string,string>")
    reg = spark.createDataFrame([("s", True), ("t", False)], "source_id string, enabled boolean")
    assert [r["source_id"] for r in landed.dispatch({"a": d, "b": d.limit(0)}, reg).collect()] == ["s"]


def test_seeds(spark):
    from evgraph.operators.mutate import empty_graph

    assert len(seeds.ALIASES) == 135
    stored = spark.createDataFrame([("usa", "x", None)], "alias_text string, canonical_name string, canonical_node_id string")
    new = seeds.seed_aliases(spark, stored)
    assert new.count() == len(seeds.ALIASES) - 1
    g = empty_graph(spark)
    g.aliases = new
    events, after = seeds.load_seed_graph(spark, g)
    assert events.filter("rejected").count() == 0 and events.count() == 21
    assert after.nodes.count() == 14 and after.edges.count() == 7
    # Waiting aliases of a created entity now point at it.
    russia = after.aliases.filter("alias_text IN ('Russia', 'Russian Federation')")
    assert russia.select("canonical_node_id").distinct().count() == 1
    assert vocab.regions(spark).count() == 8
    assert landed.notable_events(seeds.notable_events(spark)).count() == 7


def test_seed_condition_history_starts_with_the_given_state(spark):
    from evgraph.operators.mutate import empty_graph, validate, value_history

    g = empty_graph(spark)
    events = validate(seeds.seed_operations(spark), g)
    rows = value_history(events, g.nodes, "current_state").collect()
    assert len(rows) == 5 and {(r["new_value"], r["previous_value"]) for r in rows} == {("active", None)}
