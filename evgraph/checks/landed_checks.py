"""Queries on landed responses in the providers' formats, written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evgraph.checks.registry import AS_OF, SQL_AS_OF, query
from evgraph.checks.tables import duck
from evgraph.operators import mutate
from evgraph.plans import changes, market, review, scenarios
from evgraph.plans.extract import parse_scenarios
from evgraph.sources import landed, sinks

_CLOCK = "lpad(cast(c_custkey % 24 AS string), 2, '0')"


def _landed(d, body: str, *extra: str):
    """Rows of a reader's input: source, fetch time and the body built by SQL."""
    return d.selectExpr(
        "'s' AS source_id", "'us_eu' AS perspective", f"{SQL_AS_OF} AS fetched_at", f"{body} AS body", *extra
    )


@query("feed_rows", f"""
WITH c AS (SELECT *, c_custkey % 24 AS h FROM customer)
SELECT concat('http://x/', c_custkey) AS url, concat(c_name, chr(10), chr(10), c_mktsegment) AS content,
  timestamp '2024-01-02 00:30:00' + to_hours(cast(h AS int)) AS content_timestamp FROM c
UNION ALL SELECT concat('feed/', c_custkey), concat('Second ', c_custkey), {SQL_AS_OF} FROM c""")
def feed_rows(t):
    body = f"""concat('<rss><channel><item><title>', c_name, '</title><description>', c_mktsegment,
      '</description><link>http://x/', c_custkey, '</link><pubDate>Tue, 02 Jan 2024 ', {_CLOCK},
      ':30:00 GMT</pubDate></item><item><title>Second ', c_custkey, '</title></item>',
      '<item><title> </title></item></channel></rss>')"""
    d = _landed(t["customer"], body, "concat('feed/', c_custkey) AS feed_url", "'label' AS feed_label")
    sources = t["sources"].selectExpr("'s' AS source_id", "'us_eu' AS perspective", "array('en') AS languages")
    return landed.feed_entries(d.drop("perspective"), sources.distinct()).select(
        "url", "content", "content_timestamp"
    )


@query("search_rows", f"""
SELECT concat('u/', p_partkey, '/', k) AS url,
  CASE k WHEN 0 THEN concat(p_name, chr(10), chr(10), p_type) ELSE p_name END AS content,
  CASE k WHEN 0 THEN timestamp '2024-01-02 02:04:05' ELSE {SQL_AS_OF} END AS content_timestamp,
  p_brand AS query FROM part, (SELECT unnest([0, 1]) AS k) r""")
def search_rows(t):
    body = """concat('{"results":[{"title":"', p_name, '","content":"', p_type, '","url":"u/', p_partkey,
      '/0","publishedDate":"Tue, 02 Jan 2024 03:04:05 +0100"},{"title":"', p_name, '","url":"u/', p_partkey,
      '/1"},{"url":"empty"}]}')"""
    d = landed.search_results(_landed(t["part"], body, "p_brand AS query"))
    return d.select("url", "content", "content_timestamp", F.col("metadata")["query"].alias("query"))


_QUAKE = """concat('{"features":[{"id":"q', point_id, '","geometry":{"coordinates":[', lon, ',', lat, ',12.5]},
  "properties":{"mag":', CASE WHEN point_id % 10 = 0 THEN 'null' WHEN point_id % 10 = 1 THEN '0'
  ELSE '4.25' END, ',"place":"P', point_id, '","time":', TIME, ',"depth":7}}]}')"""


@query("quake_rows", duck("""
SELECT concat('q', point_id) AS event_id, timestamp '2024-01-02 00:00:00' + to_seconds(point_id)
    AS content_timestamp,
  concat('USGS Earthquake: M', CASE WHEN point_id % 10 = 1 THEN '0.0' ELSE '4.3' END, ' — P', point_id, chr(10),
    'Time: ', strftime(timestamp '2024-01-02 00:00:00' + to_seconds(point_id), '%Y-%m-%dT%H:%M:%S+00:00'),
    chr(10), 'Depth: 12.5 km', chr(10), 'Coordinates: ', printf('%.3f', lat), '°N, ', printf('%.3f', lon),
    '°E', chr(10)) AS content
FROM points WHERE point_id % 10 <> 0""", "points"))
def quake_rows(t):
    body = _QUAKE.replace("TIME", "cast(1704153600000 + point_id * 1000 AS string)")
    d = landed.quakes_ms(_landed(t["points"], body, "'req' AS request_url"))
    return d.select(F.col("metadata")["event_id"].alias("event_id"), "content_timestamp", "content")


@query("quake_iso_rows", duck("""
SELECT concat('q', point_id) AS event_id, timestamp '2024-01-02 03:04:05' AS content_timestamp,
  concat('Earthquake detected: M4.25 P', point_id, '. Depth: 7 km. Coordinates: ', printf('%.2f', lat), 'N, ',
    printf('%.2f', lon), 'E. Event ID: q', point_id, '. Time: 2024-01-02T03:04:05Z.') AS content
FROM points WHERE point_id % 10 NOT IN (0, 1)""", "points"))
def quake_iso_rows(t):
    body = _QUAKE.replace("TIME", "'\"2024-01-02T03:04:05Z\"'")
    d = landed.quakes_iso(_landed(t["points"], body, "'req' AS request_url"))
    return d.select(F.col("metadata")["event_id"].alias("event_id"), "content_timestamp", "content")


@query("observation_rows", """
SELECT concat('s', o_orderkey) AS series_id, date_trunc('day', o_orderdate)::timestamp AS ts, o_totalprice AS value
FROM orders""")
def observation_rows(t):
    body = """concat('{"observations":[{"date":"', date_format(o_orderdate, 'yyyy-MM-dd'), '","value":"',
      o_totalprice, '"},{"date":"2024-01-01","value":"."},{"date":"2024-01-01","value":""}]}')"""
    return landed.observations(
        t["orders"].selectExpr("concat('s', o_orderkey) AS series_id", f"{body} AS body"))


@query("chart_rows", """
SELECT concat('s', o_orderkey) AS symbol, k AS pos, o_totalprice + k AS close,
  timestamp '2024-01-01' + to_days(k) AS ts, timestamp '2024-01-03' AS last_ts
FROM orders, (SELECT unnest([0, 2])::int AS k) r""")
def chart_rows(t):
    body = """concat('{"chart":{"result":[{"timestamp":[1704067200,1704153600,1704240000],"indicators":{"quote":',
      '[{"close":[', o_totalprice, ',null,', o_totalprice + 2, ']}]}}]}}')"""
    return landed.chart_closes(
        t["orders"].selectExpr("concat('s', o_orderkey) AS symbol", f"{body} AS body"))


@query("corroboration", duck("""
, f AS (SELECT symbol, arg_max(close, ts) AS l, arg_min(close, ts) AS p FROM closes GROUP BY symbol)
, m AS (SELECT symbol, (l - p) / p * 100 AS a,
  (SELECT max(ts) FROM closes c WHERE c.symbol = f.symbol) - interval '30' day AS cut, l FROM f)
, n AS (SELECT symbol, a, (l - (SELECT arg_max(close, ts) FROM closes c WHERE c.symbol = m.symbol AND c.ts <= cut))
  / (SELECT arg_max(close, ts) FROM closes c WHERE c.symbol = m.symbol AND c.ts <= cut) * 100 AS b FROM m)
SELECT symbol, round(a, 6) AS pct_a, round(b, 6) AS pct_b,
  CASE WHEN abs(a - b) <= 5 THEN 'agree' ELSE 'diverge' END AS verdict FROM n""", "closes"))
def corroboration(t):
    obs = t["closes"].withColumnRenamed("close", "value")
    pairs = obs.select(F.col("symbol").alias("symbol_a"), F.col("symbol").alias("symbol_b")).distinct()
    d = market.corroborate(market.move_by_days(obs, 36_500), market.move_by_days(obs, 30), pairs, tolerance=5.0)
    return d.select(F.col("symbol_a").alias("symbol"), F.round("pct_a", 6).alias("pct_a"),
                    F.round("pct_b", 6).alias("pct_b"), "verdict")


@query("challenge_responses", duck("""
SELECT pass_event_id, CASE pass_event_id % 5 WHEN 0 THEN 'found' WHEN 1 THEN 'not_found' ELSE 'error' END
    AS outcome, CASE pass_event_id % 5 WHEN 3 THEN 'No JSON found in LLM output.'
    WHEN 4 THEN 'Could not parse LLM output.' ELSE concat('why ', pass_event_id) END AS reasoning,
  CASE pass_event_id % 5 WHEN 0 THEN 1 ELSE 0 END AS n_allowed FROM challenges""", "challenges"))
def challenge_responses(t):
    answer = """concat('{"outcome":"', OUT, '","reasoning":"why ', pass_event_id, '","operations":[
      {"operation":"update_edge_weight","target_edge_id":"', edge_id, '"},{"operation":"create_edge"}]}')"""
    body = f"""CASE pass_event_id % 5 WHEN 0 THEN {answer.replace('OUT', "'found'")}
      WHEN 1 THEN concat('```json\\n', {answer.replace('OUT', "'not_found'")}, '\\n```')
      WHEN 2 THEN concat('Well: ', {answer.replace('OUT', "'perhaps'")}, ' so.')
      WHEN 3 THEN 'nothing' ELSE '{{broken}}' END"""
    d = review.parse_challenges(t["challenges"].selectExpr("pass_event_id", f"{body} AS body"))
    ops = review.challenge_operations(d).groupBy("pass_event_id").agg(F.count(F.lit(1)).alias("n"))
    return d.join(ops, "pass_event_id", "left").select(
        "pass_event_id", "outcome", "reasoning", F.coalesce("n", F.lit(0)).cast("int").alias("n_allowed")
    )


_SAVE = "cast(doc_id % 28 AS int)"


@query("scenario_store", f"""
WITH s AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'economic_stability' WHEN 1 THEN 'geopolitical_tension'
    WHEN 2 THEN 'resource_availability' WHEN 3 THEN 'environmental_stress' WHEN 4 THEN 'structural_change' END
    AS dimension, {_SAVE} AS save_no FROM documents)
, l AS (SELECT dimension, max(save_no) AS last FROM s GROUP BY dimension)
SELECT concat('Title ', doc_id) AS title, s.dimension, 'moderate' AS probability_band,
  CASE doc_id % 2 WHEN 0 THEN '1 year' ELSE '3–6 months' END AS time_horizon, save_no < last AS deprecated
FROM s JOIN l ON l.dimension IS NOT DISTINCT FROM s.dimension""")
def scenario_store(t):
    return scenarios.with_deprecation(parse_scenarios(scenario_responses(t).drop("doc_id"))).select(
        "title", "dimension", "probability_band", "time_horizon", "deprecated"
    )


def scenario_responses(t):
    """A landed response per document, with the number of its save."""
    body = """concat('```json\\n[{"title":" Title ', doc_id, ' ","summary":"s","probability_band":"sure"',
      CASE doc_id % 2 WHEN 0 THEN ',"time_horizon":"1 year"' ELSE '' END, '},{"title":"no summary"},7]\\n```')"""
    dim = """CASE doc_id % 6 WHEN 0 THEN 'economic_stability' WHEN 1 THEN 'geopolitical_tension'
      WHEN 2 THEN 'resource_availability' WHEN 3 THEN 'environmental_stress' WHEN 4 THEN 'structural_change' END"""
    return t["documents"].selectExpr(
        "doc_id", f"{dim} AS dimension", f"{body} AS body", f"{SQL_AS_OF} AS as_of",
        f"{SQL_AS_OF} + doc_id * interval '1' minute AS generated_at", "'m' AS model_used",
        f"{_SAVE} AS save_no", "true AS replaces",
    )


@query("signal_states", duck("""
, m AS (SELECT signal_id, max(event_id) FILTER (WHERE event_id % 2 = 0) AS a,
  max(event_id) FILTER (WHERE event_id % 2 = 1) AS c FROM event_triggers GROUP BY signal_id)
SELECT s.signal_id, s.anchored OR m.a IS NOT NULL AS anchored, cast(m.c AS varchar) AS cluster_id
FROM signals s LEFT JOIN m USING (signal_id)""", "signals", "event_triggers"))
def signal_states(t):
    states = t["event_triggers"].select(
        "signal_id", F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 2 == 0, F.lit(True)).alias("anchored"),
        F.when(F.col("event_id") % 2 == 1, F.col("event_id").cast("string")).alias("cluster_id"),
        F.lit(1.0).alias("cluster_strength"),
    )
    return sinks.signal_states(t["signals"], states).select("signal_id", "anchored", "cluster_id")


def _updates(t):
    """Each state change of a condition as an update of that node."""
    ops = t["condition_history"].select(
        F.date_format("content_timestamp", "yyyyMMdd").alias("batch_id"),
        F.col("content_timestamp").alias("batch_time"), F.col("id").alias("pos"),
        F.lit("update_node").alias("operation"), F.col("node_id").alias("target_node_id"),
        F.map_from_arrays(
            F.array(F.lit("current_state"), F.lit("seen")), F.array("new_state", F.col("id").cast("string"))
        ).alias("field_updates"),
        F.lit("anchoring").alias("source"),
    )
    graph = mutate.empty_graph(t.spark)
    graph.nodes = t["condition_nodes"].select(
        "node_id", "node_type", "name", "description",
        F.create_map(F.lit("current_state"), F.lit("unknown")).alias("type_data"), "created_at",
        F.col("created_at").alias("updated_at"),
    )
    return mutate.validate(ops, graph, id_pattern=r"^u\d+$"), graph.nodes


@query("state_history", duck("""
SELECT node_id, id AS pos, new_state AS new_value, coalesce(lag(new_state) OVER (PARTITION BY node_id
  ORDER BY content_timestamp, id), 'unknown') AS previous_value FROM condition_history""", "condition_history"))
def state_history(t):
    events, nodes = _updates(t)
    return mutate.value_history(events, nodes, "current_state").select(
        "node_id", "pos", "new_value", "previous_value"
    )


@query("updated_nodes", duck("""
SELECT node_id, arg_max(new_state, (content_timestamp, id)) AS current_state,
  cast(arg_max(id, (content_timestamp, id)) AS varchar) AS seen, max(content_timestamp) AS updated_at
FROM condition_history GROUP BY node_id""", "condition_history"))
def updated_nodes(t):
    events, nodes = _updates(t)
    d = mutate.fold_nodes(events, nodes)
    get = lambda k: F.try_element_at("type_data", F.lit(k)).alias(k)
    return d.select("node_id", get("current_state"), get("seen"), "updated_at")


@query("resolved_names", duck("""
, a AS (SELECT name, min(node_id) AS node_id FROM name_nodes GROUP BY name)
SELECT p_partkey, a.node_id AS canonical_node_id FROM part
JOIN a ON a.name = concat(p_name, ' ', lower(p_brand))""", "name_nodes"))
def resolved_names(t):
    aliases = t["name_nodes"].groupBy(F.upper("name").alias("alias_text")).agg(
        F.min("node_id").alias("canonical_node_id"), F.min("name").alias("canonical_name")
    )
    names = t["part"].selectExpr("p_partkey", "concat('  ', p_name, ' ', p_brand, '\\n') AS name")
    return mutate.resolve_names(names, "name", aliases).select("p_partkey", "canonical_node_id")


@query("new_event_changes", duck(f"""
, k AS (SELECT n.*, CASE WHEN current_state = 'unknown' THEN 'event' ELSE node_type END AS kind
  FROM condition_nodes n)
SELECT concat('event-new-', node_id) AS change_id, concat('New event: ', name, '.') AS summary FROM k
WHERE kind = 'event' AND created_at BETWEEN {SQL_AS_OF} - interval '720' hour AND {SQL_AS_OF}
  AND EXISTS (SELECT 1 FROM edges e JOIN k o ON o.kind = 'condition' AND o.current_state = 'active'
    AND ((e.source_node_id = k.node_id AND e.target_node_id = o.node_id)
      OR (e.target_node_id = k.node_id AND e.source_node_id = o.node_id)) WHERE NOT e.deprecated)""",
    "condition_nodes", "edges"))
def new_event_changes(t):
    n = t["condition_nodes"].withColumn(
        "node_type", F.when(F.col("current_state") == "unknown", "event").otherwise(F.col("node_type"))
    )
    d = changes.new_event_changes(n, t["edges"], as_of=AS_OF, hours=720)
    return d.select("change_id", "summary")
