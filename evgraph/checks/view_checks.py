"""Queries on the home view: changes, dimensions, topics, regions, evidence, calibration, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.checks.ingest_checks import CHECKED, checked, sql_list
from evgraph.checks.registry import AS_OF, SQL_AS_OF, query
from evgraph.checks.tables import duck
from evgraph.plans import calibrate, changes, dimensions, health, sessions, signals, topics
from evgraph.sources import sinks


def _hits(text: str, d: str) -> str:
    return f"len(list_filter({sql_list(vocab.DIMENSION_KEYWORDS[d])}, lambda k: contains({text}, k)))"


def _best(text: str) -> str:
    """Best dimension of a text in DuckDB: most hits, first on ties, default when none."""
    dims = vocab.DIMENSIONS
    n = [_hits(f"lower({text})", d) for d in dims]
    top = f"greatest({', '.join(n)})"
    cases = " ".join(f"WHEN {x} = {top} THEN '{d}'" for x, d in zip(n, dims))
    return f"CASE WHEN {top} = 0 THEN 'structural_change' {cases} END"


def _label(d: str) -> str:
    return "CASE " + d + " " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in vocab.DIMENSION_LABELS.items()) + " END"


_VERB = "CASE edge_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in vocab.EDGE_VERBS.items()) + " END"
_HIGH = "IN ('strong', 'moderate')"
_SINCE = f"{SQL_AS_OF} - interval '24' hour"

# Change records of a window that starts at the moment put in for {since}.
_CHANGES = f"""
, eh AS (SELECT *, lag(weight_band) OVER (PARTITION BY edge_id ORDER BY content_timestamp, id) AS prev
  FROM edge_history)
, ch AS (SELECT *, lag(new_state) OVER (PARTITION BY node_id ORDER BY content_timestamp, id) AS prev
  FROM condition_history)
, en AS (SELECT e.*, s.name AS sn, d.name AS dn, concat(s.name, ' ', {_VERB}, ' ', d.name) AS phrase
  FROM edges e JOIN condition_nodes s ON s.node_id = e.source_node_id
  JOIN condition_nodes d ON d.node_id = e.target_node_id)
, w AS (SELECT eh.id, eh.edge_id, weight_band, prev, change_type, content_timestamp, phrase FROM eh
  JOIN en USING (edge_id) WHERE content_timestamp BETWEEN {{since}} AND {SQL_AS_OF}
  AND change_type IN ('strengthened', 'weakened', 'disconfirmation')
  AND (weight_band {_HIGH} OR prev {_HIGH}) AND NOT deprecated
  ORDER BY content_timestamp DESC, eh.id DESC {{cap50}})
, s AS (SELECT ch.id, ch.node_id, new_state, content_timestamp, name, description FROM ch
  JOIN condition_nodes USING (node_id) WHERE content_timestamp BETWEEN {{since}} AND {SQL_AS_OF}
  AND new_state IN ('active', 'inactive') AND (prev IS NULL OR prev <> new_state)
  ORDER BY content_timestamp DESC, ch.id DESC {{cap50}})
, n AS (SELECT * FROM en WHERE created_at BETWEEN {{since}} AND {SQL_AS_OF}
  AND current_weight_band {_HIGH} AND NOT deprecated ORDER BY created_at DESC, edge_id DESC {{cap30}})
, rec AS (
  SELECT concat('ewh-', id) AS change_id, CASE change_type WHEN 'disconfirmation'
      THEN 'disconfirmation_weakened' WHEN 'strengthened' THEN 'edge_strengthened'
      ELSE 'edge_weakened' END AS change_type,
    CASE change_type WHEN 'disconfirmation' THEN concat('Disconfirmation weakened: ', phrase, '.')
      WHEN 'strengthened' THEN concat('Strengthened to ', weight_band, ': ', phrase, '.')
      ELSE concat('Weakened to ', weight_band, ': ', phrase, '.') END AS summary,
    {_best('phrase')} AS dimension, content_timestamp AS occurred_at, edge_id AS target_id,
    'edge' AS target_type, phrase AS target_name, prev AS weight_before, weight_band AS weight_after,
    CASE change_type WHEN 'disconfirmation' THEN 1 WHEN 'strengthened' THEN 2 ELSE 3 END AS impact_rank
  FROM w
  UNION ALL SELECT concat('csh-', id), CASE new_state WHEN 'active' THEN 'condition_activated'
      ELSE 'condition_deactivated' END, concat('Condition ', CASE new_state WHEN 'active'
      THEN 'activated' ELSE 'deactivated' END, ': ', name, '.'),
    {_best("concat(name, ' ', coalesce(description, ''))")}, content_timestamp, node_id, 'node', name,
    NULL, NULL, CASE new_state WHEN 'active' THEN 4 ELSE 5 END FROM s
  UNION ALL SELECT concat('edge-new-', edge_id), 'edge_created',
    concat('New ', current_weight_band, ' link established: ', phrase, '.'), {_best('phrase')},
    created_at, edge_id, 'edge', phrase, NULL, current_weight_band, 6 FROM n)
"""
_CAPPED = _CHANGES.format(since=_SINCE, cap50="LIMIT 50", cap30="LIMIT 30")
_WEEK = _CHANGES.format(since=f"{SQL_AS_OF} - interval '168' hour", cap50="", cap30="")
_TABLES = ["edge_history", "condition_history", "edges", "condition_nodes", "topic_nodes"]


def histories(t):
    """Histories with the value before each row."""
    return (
        changes.with_previous(t["edge_history"], "edge_id", "weight_band", "previous_weight_band"),
        changes.with_previous(t["condition_history"], "node_id", "new_state", "previous_state"),
    )


def recent(t, hours=24, limit=15):
    w, s = histories(t)
    return changes.recent_changes(
        t["condition_nodes"], t["edges"], w, s, t["topic_nodes"], as_of=AS_OF, hours=hours, limit=limit,
        caps=(50, 50, 30),
    )


def _week(t):
    w, s = histories(t)
    return changes.change_stream(
        t["condition_nodes"], t["edges"], w, s, as_of=AS_OF, hours=168
    )


@query("recent_changes", duck(_CAPPED + f"""
, top AS (SELECT * FROM rec ORDER BY impact_rank, occurred_at, change_id LIMIT 15)
, ends AS (SELECT edge_id, source_node_id AS n FROM edges WHERE NOT deprecated
  UNION ALL SELECT edge_id, target_node_id FROM edges WHERE NOT deprecated)
SELECT t.change_id, t.change_type, t.summary, t.dimension, {_label('t.dimension')} AS dimension_label,
  t.occurred_at, t.target_id, t.target_type, t.target_name, t.weight_before, t.weight_after,
  t.impact_rank, CASE target_type WHEN 'node' THEN (SELECT count(*) FROM ends WHERE n = t.target_id)
    ELSE (SELECT count(DISTINCT x.edge_id) FROM ends x JOIN edges e ON e.edge_id = t.target_id
      WHERE x.edge_id <> t.target_id AND (x.n = e.source_node_id OR x.n = e.target_node_id)) END
    AS downstream_edge_count,
  coalesce((SELECT string_agg(topic_id, '|' ORDER BY topic_id) FROM (SELECT DISTINCT topic_id
    FROM topic_nodes LEFT JOIN edges e ON e.edge_id = t.target_id
    WHERE node_id = t.target_id OR node_id = e.source_node_id OR node_id = e.target_node_id) z), '')
    AS topic_ids
FROM top t""", *_TABLES))
def recent_changes(t):
    return recent(t).withColumn("topic_ids", F.array_join("topic_ids", "|"))


@query("recent_changes_all", duck(_CHANGES.format(since=_SINCE, cap50="", cap30="") + """
SELECT change_id, change_type, summary, dimension, occurred_at, target_id, impact_rank FROM rec""", *_TABLES))
def recent_changes_all(t):
    w, s = histories(t)
    d = changes.change_stream(t["condition_nodes"], t["edges"], w, s, as_of=AS_OF, hours=24)
    return d.select("change_id", "change_type", "summary", "dimension", "occurred_at", "target_id", "impact_rank")


@query("changes_by_topic", duck(_WEEK + """
, tgt AS (SELECT change_id, target_id AS node_id FROM rec WHERE target_type = 'node'
  UNION SELECT change_id, source_node_id FROM rec JOIN edges ON edge_id = target_id
  UNION SELECT change_id, target_node_id FROM rec JOIN edges ON edge_id = target_id)
, m AS (SELECT DISTINCT change_id, topic_id FROM tgt JOIN topic_nodes USING (node_id))
SELECT topic_id, count(*) AS n_changes, max(occurred_at) AS last_change, min(impact_rank) AS best_rank
FROM m JOIN rec USING (change_id) GROUP BY topic_id""", *_TABLES))
def changes_by_topic(t):
    return changes.changes_by_topic(_week(t), t["edges"], t["topic_nodes"])


@query("change_week", duck(_WEEK + """
SELECT dimension, change_type, count(*) AS n, min(change_id) AS first_id, max(summary) AS last_summary
FROM rec GROUP BY ALL""", *_TABLES))
def change_week(t):
    return _week(t).groupBy("dimension", "change_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("change_id").alias("first_id"),
        F.max("summary").alias("last_summary"),
    )


_BASIS = f"""
, top AS (SELECT * FROM rec ORDER BY impact_rank, occurred_at, change_id {{limit}})
, dims AS (SELECT unnest({sql_list(vocab.DIMENSIONS)}) AS dimension)
SELECT d.dimension, cast(count(t.change_id) AS int) AS n_changes,
  substring(sha256(coalesce(string_agg(t.change_id, '|' ORDER BY t.change_id), '')), 1, 16) AS basis_hash
FROM dims d LEFT JOIN top t ON t.dimension = d.dimension GROUP BY d.dimension"""


@query("change_basis", duck(_CAPPED + _BASIS.format(limit="LIMIT 60"), *_TABLES))
def change_basis(t):
    w, s = histories(t)
    d = changes.change_stream(t["condition_nodes"], t["edges"], w, s, as_of=AS_OF, caps=(50, 50, 30))
    return changes.change_basis(changes.rank_changes(d, 60))


@query("change_basis_all", duck(_CHANGES.format(since=_SINCE, cap50="", cap30="") + _BASIS.format(limit=""), *_TABLES))
def change_basis_all(t):
    w, s = histories(t)
    d = changes.change_stream(t["condition_nodes"], t["edges"], w, s, as_of=AS_OF)
    return changes.change_basis(d)


# --- dimensions ------------------------------------------------------------------------------

_DIMS = f"""
, dims AS (SELECT unnest({sql_list(vocab.DIMENSIONS)}) AS dimension)
, txt AS (SELECT node_id, current_state, lower(concat(name, ' ', coalesce(description, ''))) AS x
  FROM condition_nodes WHERE created_at <= {SQL_AS_OF})
, hit AS ({" UNION ALL ".join(f"SELECT node_id, current_state, '{d}' AS dimension FROM txt WHERE {_hits('x', d)} > 0" for d in vocab.DIMENSIONS)})
, mem AS (SELECT * FROM hit UNION ALL SELECT node_id, current_state, 'structural_change' FROM txt
  WHERE node_id NOT IN (SELECT node_id FROM hit))
, weeks AS (SELECT coalesce(m.dimension, 'structural_change') AS dimension,
    date_trunc('week', content_timestamp)::timestamp AS week_start,
    count(*) FILTER (WHERE new_state = 'active') AS active_count, count(*) AS total_count
  FROM condition_history h LEFT JOIN mem m ON m.node_id = h.node_id
  WHERE content_timestamp BETWEEN {SQL_AS_OF} - interval '91' day AND {SQL_AS_OF} GROUP BY ALL)
, sh AS (SELECT dimension, active_count / total_count AS y,
    row_number() OVER (PARTITION BY dimension ORDER BY week_start DESC) AS back,
    count(*) OVER (PARTITION BY dimension) AS n_all FROM weeks)
, win AS (SELECT dimension, y, n_all, least(n_all, 6) AS n, least(n_all, 6) - back AS i
  FROM sh WHERE back <= 6)
, fit AS (SELECT dimension, max(n_all) AS n_all, max(n) AS n, coalesce(regr_slope(y, i), 0) AS rate,
    coalesce(regr_slope(y, i) FILTER (WHERE i < n - n // 2), 0) AS lead_s,
    coalesce(regr_slope(y, i) FILTER (WHERE i >= n // 2), 0) AS tail_s FROM win GROUP BY dimension)
, vel AS (SELECT d.dimension,
    CASE WHEN n_all >= 3 THEN round(rate, 4) ELSE 0 END AS rate,
    CASE WHEN n_all IS NULL OR n_all < 3 THEN 'insufficient data' WHEN abs(rate) < 0.005 THEN 'steady'
      ELSE concat(CASE WHEN abs(rate) < 0.02 THEN 'gentle' WHEN abs(rate) < 0.05 THEN 'moderate'
        ELSE 'steep' END, ' ', CASE WHEN rate > 0 THEN 'rising' ELSE 'easing' END) END AS rate_label,
    CASE WHEN n >= 4 THEN round(tail_s - lead_s, 4) ELSE 0 END AS acceleration,
    CASE WHEN n IS NULL OR n < 4 THEN '—' WHEN abs(abs(tail_s) - abs(lead_s)) < 0.005 THEN 'linear'
      WHEN abs(tail_s) > abs(lead_s) THEN 'accelerating' ELSE 'decelerating' END AS accel_label
  FROM dims d LEFT JOIN fit f ON f.dimension = d.dimension)
, ends AS (SELECT source_node_id AS node_id, current_weight_band {_HIGH} AS high FROM edges
    WHERE NOT deprecated AND created_at <= {SQL_AS_OF}
  UNION ALL SELECT target_node_id, current_weight_band {_HIGH} FROM edges
    WHERE NOT deprecated AND created_at <= {SQL_AS_OF})
, str AS (SELECT node_id, count(*) FILTER (WHERE high) AS s, count(*) FILTER (WHERE NOT high) AS k
  FROM ends GROUP BY node_id)
, st AS (SELECT node_id,
    arg_max(new_state, (content_timestamp, id)) FILTER
      (WHERE content_timestamp >= {SQL_AS_OF} - interval '14' day) AS recent,
    arg_max(new_state, (content_timestamp, id)) FILTER
      (WHERE content_timestamp < {SQL_AS_OF} - interval '14' day) AS prior
  FROM condition_history WHERE content_timestamp BETWEEN {SQL_AS_OF} - interval '28' day AND {SQL_AS_OF}
  GROUP BY node_id)
, agg AS (SELECT d.dimension, count(m.node_id) AS total_conditions,
    count(*) FILTER (WHERE m.current_state = 'active') AS active_conditions,
    cast(coalesce(sum(s), 0) AS bigint) AS strong_edge_count,
    cast(coalesce(sum(k), 0) AS bigint) AS weak_edge_count,
    count(*) FILTER (WHERE recent = 'active') - count(*) FILTER (WHERE prior = 'active') AS delta
  FROM dims d LEFT JOIN mem m ON m.dimension = d.dimension LEFT JOIN str USING (node_id)
  LEFT JOIN st USING (node_id) GROUP BY d.dimension)
, score AS (SELECT a.*, {_label('a.dimension')} AS label,
    CASE WHEN total_conditions = 0 THEN 'unknown'
      WHEN active_conditions / total_conditions < 0.2 THEN 'improving'
      WHEN active_conditions / total_conditions < 0.4 THEN 'stable'
      WHEN active_conditions / total_conditions < 0.6 THEN 'strained'
      WHEN active_conditions / total_conditions < 0.8 THEN 'deteriorating' ELSE 'crisis' END AS state,
    CASE WHEN total_conditions = 0 OR (SELECT count(*) FROM st) = 0 THEN 'unknown'
      WHEN delta > 1 THEN 'worsening' WHEN delta < -1 THEN 'improving' ELSE 'steady' END AS direction,
    v.rate, v.rate_label, v.acceleration, v.accel_label FROM agg a JOIN vel v USING (dimension))
"""
_DIM_TABLES = ["condition_nodes", "edges", "condition_history"]


def scores(t):
    return dimensions.dimension_scores(
        t["condition_nodes"], t["edges"], t["condition_history"], as_of=AS_OF
    )


@query("dimension_scores", duck(_DIMS + "SELECT * EXCLUDE (delta) FROM score", *_DIM_TABLES))
def dimension_scores(t):
    return scores(t)


@query("dimension_series", duck(_DIMS + "SELECT * FROM weeks", *_DIM_TABLES))
def dimension_series(t):
    return dimensions.weekly_series(t["condition_nodes"], t["condition_history"], AS_OF)


@query("dimension_velocity", duck(_DIMS + "SELECT * FROM vel", *_DIM_TABLES))
def dimension_velocity(t):
    return dimensions.velocity(
        dimensions.weekly_series(t["condition_nodes"], t["condition_history"], AS_OF)
    )


@query("verdict", duck(_DIMS + """
, v AS (SELECT round(avg(CASE state WHEN 'improving' THEN 0.1 WHEN 'stable' THEN 0.3 WHEN 'strained'
    THEN 0.5 WHEN 'deteriorating' THEN 0.7 WHEN 'crisis' THEN 0.9 ELSE 0.5 END), 6) AS composite,
  sum(strong_edge_count) / sum(strong_edge_count + weak_edge_count) AS share,
  bool_or(direction = 'improving') AND bool_or(direction = 'worsening') AS split,
  concat((SELECT string_agg(concat(n, ' ', state), ', ' ORDER BY o) FROM (SELECT state, count(*) AS n,
    list_position(['improving', 'stable', 'strained', 'deteriorating', 'crisis'], state) AS o
    FROM score WHERE state <> 'unknown' GROUP BY state) z), '.') AS subline FROM score)
SELECT composite, CASE WHEN composite < 0.2 THEN 'At present, yes.'
  WHEN composite < 0.4 THEN 'Holding, for now.' WHEN composite < 0.6 THEN 'Under pressure.'
  WHEN composite < 0.75 THEN 'Not at present.' ELSE 'Under serious stress.' END AS headline, subline,
  concat(CASE WHEN share < 0.33 THEN 'low' WHEN share < 0.66 THEN 'moderate' ELSE 'high' END, ', ',
    CASE WHEN split THEN 'widening' ELSE 'aligned' END) AS regime FROM v""", *_DIM_TABLES))
def verdict(t):
    return dimensions.verdict(scores(t))


@query("condition_overview", duck(f"""
SELECT split_part(name, ' ', 1) AS dimension, count(*) AS total,
  count(*) FILTER (WHERE current_state = 'active') AS active FROM condition_nodes
WHERE created_at <= {SQL_AS_OF} GROUP BY 1""", "condition_nodes"))
def condition_overview(t):
    d = t["condition_nodes"].withColumn("dimension", F.split_part("name", F.lit(" "), F.lit(1)))
    return topics.condition_overview(d, AS_OF)


# --- topics and regions ----------------------------------------------------------------------

def _topics_sql(nodes: str, edges: str) -> str:
    return f"""
, kn AS ({nodes}), ke AS ({edges})
, m AS (SELECT t.topic_id, t.node_id, n.current_state FROM topic_nodes t JOIN kn n USING (node_id))
, i AS (SELECT a.topic_id, count(DISTINCT e.edge_id) AS n FROM ke e
  JOIN m a ON a.node_id = e.source_node_id
  JOIN m b ON b.node_id = e.target_node_id AND b.topic_id = a.topic_id GROUP BY a.topic_id)
, c AS (SELECT t.topic_id, t.name, count(m.node_id) AS node_count,
  count(*) FILTER (WHERE m.current_state = 'active') AS active_condition_count,
  coalesce(max(i.n), 0) AS edge_count
  FROM topics t LEFT JOIN m USING (topic_id) LEFT JOIN i USING (topic_id) GROUP BY t.topic_id, t.name)
, b AS (SELECT *, CASE WHEN node_count = 0 THEN 'unknown'
  WHEN active_condition_count / node_count < 0.2 THEN 'improving'
  WHEN active_condition_count / node_count < 0.4 THEN 'stable'
  WHEN active_condition_count / node_count < 0.6 THEN 'strained'
  WHEN active_condition_count / node_count < 0.8 THEN 'deteriorating' ELSE 'crisis' END AS state FROM c)
SELECT *, CASE WHEN state IN ('crisis', 'deteriorating') THEN 'high' WHEN state = 'strained' THEN 'medium'
  ELSE 'low' END AS attention FROM b"""


_TOPIC_TABLES = ["topics", "topic_nodes", "condition_nodes", "edges"]


@query("topic_list", duck(_topics_sql(
    "SELECT * FROM condition_nodes", "SELECT * FROM edges WHERE NOT deprecated"), *_TOPIC_TABLES))
def topic_list(t):
    return topics.topic_list(t["topics"], t["topic_nodes"], t["condition_nodes"], t["edges"])


_EARLY = "timestamp '2024-01-01 06:00:00'"


@query("topic_detail", duck(_topics_sql(
    f"SELECT * FROM condition_nodes WHERE created_at <= {_EARLY}",
    f"SELECT * FROM edges WHERE NOT deprecated AND created_at <= {_EARLY}"), *_TOPIC_TABLES))
def topic_detail(t):
    return topics.topic_detail(
        t["topics"], t["topic_nodes"], t["condition_nodes"], t["edges"],
        as_of=AS_OF.replace(day=1, hour=6),
    )


@query("topics_of_node", duck("""
SELECT node_id, topic_id, t.name FROM topic_nodes JOIN topics t USING (topic_id)
WHERE node_id IN (SELECT node_id FROM condition_nodes WHERE current_state = 'active')""", *_TOPIC_TABLES))
def topics_of_node(t):
    active = t["condition_nodes"].filter("current_state = 'active'")
    return topics.topics_of_nodes(active, t["topic_nodes"], t["topics"]).select(
        "node_id", "topic_id", "name"
    )


@query("topic_related", duck("""
SELECT a.topic_id AS topic_a, b.topic_id AS topic_b, count(*) AS shared_members
FROM topic_nodes a JOIN topic_nodes b ON a.node_id = b.node_id AND a.topic_id < b.topic_id
GROUP BY ALL""", "topic_nodes"))
def topic_related(t):
    return topics.related_topics(t["topic_nodes"])


_BOXES = ", ".join(
    f"('{r[0]}', {r[4]}, {r[5]}, {r[6]}, {r[7]})" for r in vocab.REGIONS if r[0] != "global")
_POINTS = f"""
, box AS (SELECT * FROM (VALUES {_BOXES}) v(region_id, a, b, c, d))
, best AS (SELECT point_id, region_id FROM points JOIN box
  ON lat BETWEEN a AND b AND lon BETWEEN c AND d
  QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY (b - a) * (d - c), region_id) = 1)
, placed AS (SELECT p.*, coalesce(x.region_id, 'global') AS region_id FROM points p
  LEFT JOIN best x ON x.point_id = p.point_id)
"""


@query("region_of_points", duck(_POINTS + "SELECT * FROM placed", "points"))
def region_of_points(t):
    return topics.region_of_points(t["points"], vocab.regions(t.spark))


_KEYS = " UNION ALL ".join(
    f"SELECT '{r[0]}' AS region_id, {sql_list(r[3]) if r[3] else '[]::varchar[]'} AS kws"
    for r in vocab.REGIONS)


@query("region_scope", duck(_POINTS + _CAPPED + f"""
, top AS (SELECT * FROM rec ORDER BY impact_rank, occurred_at, change_id LIMIT 15)
, k AS ({_KEYS})
, cnt AS (SELECT region_id, count(*) AS n FROM k, top WHERE len(kws) = 0 OR len(list_filter(kws,
  lambda z: contains(lower(target_name), z) OR contains(lower(summary), z))) > 0 GROUP BY region_id)
SELECT point_id, region_id, coalesce(n, 0) AS n_changes FROM placed LEFT JOIN cnt USING (region_id)""",
    "points", *_TABLES))
def region_scope(t):
    w, s = histories(t)
    d = changes.change_stream(t["condition_nodes"], t["edges"], w, s, as_of=AS_OF)
    top = changes.rank_changes(d, 15)
    return topics.region_scope(t["points"], vocab.regions(t.spark), top).select(
        "point_id", "region_id", "n_changes"
    )


# --- evidence ------------------------------------------------------------------------------------

def _by_keyword(text: str, cols: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {cols} FROM {source} WHERE {_hits(f'lower({text})', d)} > 0"
        for d in vocab.DIMENSIONS)


def _evidence(t, pre=(100, 100, 30)):
    return topics.evidence_bundle(t["condition_nodes"], t["edges"], t["edge_history"], as_of=AS_OF, pre=pre)


_EV_TABLES = ["condition_nodes", "edges", "edge_history"]


@query("evidence_conditions", duck(f"""
, c AS (SELECT * FROM condition_nodes WHERE current_state = 'active' AND created_at <= {SQL_AS_OF}
  ORDER BY updated_at DESC, node_id LIMIT 100)
, d AS ({_by_keyword("concat(name, ' ', coalesce(description, ''))", "node_id, name, updated_at", "c")})
SELECT dimension, node_id, name FROM d
QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY updated_at DESC, node_id) <= 20""", *_EV_TABLES))
def evidence_conditions(t):
    return _evidence(t)[0].select("dimension", "node_id", "name")


@query("evidence_edges", duck(f"""
, c AS (SELECT e.*, s.name AS sn, d.name AS dn, CASE current_weight_band WHEN 'strong' THEN 0 ELSE 1 END
    AS r FROM edges e JOIN condition_nodes s ON s.node_id = e.source_node_id
  JOIN condition_nodes d ON d.node_id = e.target_node_id
  WHERE current_weight_band {_HIGH} AND NOT deprecated AND e.created_at <= {SQL_AS_OF}
  ORDER BY r, e.updated_at DESC, edge_id LIMIT 100)
, d AS ({_by_keyword("concat(sn, ' ', dn)", "edge_id, r, updated_at", "c")})
SELECT dimension, edge_id FROM d
QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY r, updated_at DESC, edge_id) <= 25""", *_EV_TABLES))
def evidence_edges(t):
    return _evidence(t)[1].select("dimension", "edge_id")


@query("evidence_conditions_all", duck(f"""
, c AS (SELECT * FROM condition_nodes WHERE current_state = 'active' AND created_at <= {SQL_AS_OF})
, d AS ({_by_keyword("concat(name, ' ', coalesce(description, ''))", "node_id, name, updated_at", "c")})
SELECT dimension, node_id, name FROM d
QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY updated_at DESC, node_id) <= 20""", *_EV_TABLES))
def evidence_conditions_all(t):
    return _evidence(t, (None, None, None))[0].select("dimension", "node_id", "name")


@query("evidence_edges_all", duck(f"""
, c AS (SELECT e.*, s.name AS sn, d.name AS dn, CASE current_weight_band WHEN 'strong' THEN 0 ELSE 1 END
    AS r FROM edges e JOIN condition_nodes s ON s.node_id = e.source_node_id
  JOIN condition_nodes d ON d.node_id = e.target_node_id
  WHERE current_weight_band {_HIGH} AND NOT deprecated AND e.created_at <= {SQL_AS_OF})
, d AS ({_by_keyword("concat(sn, ' ', dn)", "edge_id, r, updated_at", "c")})
SELECT dimension, edge_id FROM d
QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY r, updated_at DESC, edge_id) <= 25""", *_EV_TABLES))
def evidence_edges_all(t):
    return _evidence(t, (None, None, None))[1].select("dimension", "edge_id")


@query("evidence_changes", duck(f"""
SELECT h.id, concat(s.name, ' ', replace(edge_type, '_', ' '), ' ', d.name, ' — ',
  CASE change_type WHEN 'disconfirmation' THEN 'disconfirmed' ELSE change_type END) AS summary
FROM edge_history h JOIN edges e USING (edge_id) JOIN condition_nodes s ON s.node_id = e.source_node_id
JOIN condition_nodes d ON d.node_id = e.target_node_id
WHERE content_timestamp BETWEEN {SQL_AS_OF} - interval '14' day AND {SQL_AS_OF}
ORDER BY content_timestamp DESC, h.id DESC LIMIT 10""", *_EV_TABLES))
def evidence_changes(t):
    return _evidence(t)[2].select("id", "summary")


# --- calibration -------------------------------------------------------------------------------------

OUTCOME = f"""
, l AS (SELECT t.signal_id, target_edge_id AS edge_id FROM event_triggers t
  JOIN events_log e ON e.event_id = t.event_id AND NOT e.rejected
  QUALIFY row_number() OVER (PARTITION BY t.signal_id ORDER BY applied_at DESC, e.event_id DESC) = 1)
, five AS (SELECT edge_id, bool_or(change_type = 'strengthened') AS up,
    bool_or(change_type IN ('weakened', 'disconfirmation')) AS down
  FROM (SELECT * FROM edge_history QUALIFY row_number() OVER (PARTITION BY edge_id
    ORDER BY content_timestamp DESC, id DESC) <= 5) z GROUP BY edge_id)
, tr AS (SELECT signal_id, source_id, lens_id, content_timestamp FROM signals
  UNION ALL SELECT -doc_id - 1, source, 'market', {SQL_AS_OF} - interval '1' day FROM documents)
, o AS (SELECT tr.*, CASE
    WHEN tr.content_timestamp >= {SQL_AS_OF} THEN 'pending'
    WHEN l.edge_id IS NOT NULL AND e.deprecated THEN 'anchored_deprecated'
    WHEN l.edge_id IS NOT NULL AND up THEN 'anchored_strengthened'
    WHEN l.edge_id IS NOT NULL AND down THEN 'anchored_weakened'
    WHEN l.edge_id IS NOT NULL THEN 'anchored_persistent'
    WHEN s.signal_id IS NULL THEN 'extraction_rejected'
    WHEN s.payload_id % 3 = 0 THEN 'clustered_but_not_anchored' ELSE 'isolated_in_tier_a' END AS outcome
  FROM tr LEFT JOIN l USING (signal_id) LEFT JOIN edges e ON e.edge_id = l.edge_id
  LEFT JOIN five ON five.edge_id = l.edge_id LEFT JOIN signals s ON s.signal_id = tr.signal_id)
, sc AS (SELECT *, CASE outcome WHEN 'anchored_strengthened' THEN 1.0 WHEN 'anchored_persistent' THEN 0.3
    WHEN 'anchored_weakened' THEN -0.3 WHEN 'anchored_deprecated' THEN -1.0
    WHEN 'isolated_in_tier_a' THEN -0.2 WHEN 'pending' THEN NULL ELSE 0.0 END AS score FROM o)
"""
CAL_TABLES = ["signals", "events_log", "event_triggers", "edges", "edge_history", "sources"]


def pending(t):
    """Tracked signals and some that were never stored."""
    lost = t["documents"].select(
        (-F.col("doc_id") - 1).alias("signal_id"), F.col("source").alias("source_id"),
        F.lit("market").alias("lens_id"),
        F.lit(AS_OF.replace(day=AS_OF.day - 1)).alias("content_timestamp"),
    )
    tracked = t["signals"].select("signal_id", "source_id", "lens_id", "content_timestamp").unionAll(lost)
    return calibrate.register(None, tracked, "run")


def resolved(t):
    """Tracked signals, resolved up to the as-of moment."""
    s = t["signals"].withColumn(
        "cluster_id", F.when(F.col("payload_id") % 3 == 0, F.col("payload_id").cast("string"))
    )
    return calibrate.resolve(
        pending(t), cutoff=AS_OF, signals=s, events=t["events_log"], triggers=t["event_triggers"],
        edges=t["edges"], weight_history=t["edge_history"],
    )


@query("signal_outcome", duck(OUTCOME + """
SELECT signal_id, outcome, cast(score AS double) AS score FROM sc""", *CAL_TABLES))
def signal_outcome(t):
    return resolved(t).select("signal_id", "outcome", "score")


@query("outcome_breakdown", duck(OUTCOME + """
SELECT source_id, outcome, count(*) AS n FROM sc WHERE outcome <> 'pending' GROUP BY ALL""", *CAL_TABLES))
def outcome_breakdown(t):
    return calibrate.outcome_breakdown(resolved(t), "source_id")


@query("run_totals", duck(OUTCOME + """
SELECT count(*) AS n_total, count(*) FILTER (WHERE outcome <> 'pending') AS n_scored,
  count(*) FILTER (WHERE outcome = 'pending') AS n_pending, min(content_timestamp) AS oldest,
  max(content_timestamp) AS newest,
  (SELECT string_agg(outcome || '=' || n, '|' ORDER BY outcome) FROM (SELECT outcome, count(*) AS n
    FROM sc WHERE outcome <> 'pending' GROUP BY outcome) z) AS outcome_breakdown FROM sc""", *CAL_TABLES))
def run_totals(t):
    return calibrate.run_totals(resolved(t))


@query("source_scores", duck(OUTCOME + """
, g AS (SELECT source_id, count(*) AS n_signals, cast(sum(score) AS double) AS raw_score
  FROM sc WHERE outcome <> 'pending' GROUP BY source_id)
, j AS (SELECT g.*, raw_score / n_signals AS mean_score, tier, starting_source_weight AS prior_weight,
  CASE tier WHEN 'structured_data' THEN 0.9 WHEN '1' THEN 0.8 WHEN '2' THEN 0.7 ELSE 0.5 END
    AS tier_baseline FROM g JOIN sources USING (source_id))
, p AS (SELECT *, round(cast(0.5 * tier_baseline + 0.3 * prior_weight
  + 0.2 * greatest(0, least(1, (mean_score + 0.5) / 1.5)) AS double), 4) AS proposed_weight FROM j)
SELECT source_id, n_signals, round(raw_score, 4) AS raw_score, round(mean_score, 6) AS mean_score, tier,
  proposed_weight, abs(proposed_weight - prior_weight) > 0.15 AS flagged FROM p""", *CAL_TABLES))
def source_scores(t):
    d = calibrate.source_scores(resolved(t), t["sources"])
    return d.select("source_id", "n_signals", F.round("raw_score", 4).alias("raw_score"),
                    F.round("mean_score", 6).alias("mean_score"), "tier", "proposed_weight", "flagged")


@query("lens_scores", duck(OUTCOME + """
SELECT lens_id, count(*) AS n_signals, round(cast(sum(score) AS double) / count(*), 6) AS mean_score,
  cast(sum(score) AS double) / count(*) < -0.1 AS flagged
FROM sc WHERE outcome <> 'pending' GROUP BY lens_id""", *CAL_TABLES))
def lens_scores(t):
    d = calibrate.lens_scores(resolved(t))
    return d.select("lens_id", "n_signals", F.round("mean_score", 6).alias("mean_score"), "flagged")


@query("edge_perspectives", duck("""
SELECT l.target_edge_id AS edge_id, count(DISTINCT perspective) AS n_perspectives,
  count(DISTINCT s.signal_id) AS n_signals,
  CASE WHEN count(DISTINCT perspective) > 1 THEN 'several' ELSE 'one' END AS pools
FROM events_log l JOIN event_triggers t USING (event_id) JOIN signals s USING (signal_id)
JOIN sources c ON c.source_id = s.source_id WHERE NOT l.rejected GROUP BY 1""", *CAL_TABLES))
def edge_perspectives(t):
    return signals.edge_perspectives(t["events_log"], t["event_triggers"], t["signals"], t["sources"])


# --- operating views -----------------------------------------------------------------------------------

@query("pipeline_health", duck(CHECKED + f"""
, s AS (SELECT count(*) AS signals_total,
  count(*) FILTER (WHERE extracted_at > {SQL_AS_OF} - interval '24' hour) AS signals_24h,
  count(*) FILTER (WHERE extracted_at > {SQL_AS_OF} - interval '4' hour) AS signals_4h,
  count(*) FILTER (WHERE extracted_at > {SQL_AS_OF} - interval '1' hour) AS signals_1h,
  count(*) FILTER (WHERE payload_id % 3 <> 0) AS unclustered,
  count(*) FILTER (WHERE payload_id % 3 = 0) AS clustered,
  count(*) FILTER (WHERE payload_id % 3 <> 0 AND extracted_at < {SQL_AS_OF} - interval '1' hour)
    AS anchoring_backlog FROM signals)
, n AS (SELECT count(*) FILTER (WHERE current_state <> 'unknown') AS live_nodes,
  count(*) FILTER (WHERE current_state = 'unknown') AS deprecated_nodes,
  count(*) FILTER (WHERE current_state <> 'unknown' AND created_at > {SQL_AS_OF} - interval '24' hour)
    AS nodes_24h FROM condition_nodes)
, e AS (SELECT count(*) FILTER (WHERE NOT deprecated) AS live_edges,
  count(*) FILTER (WHERE deprecated) AS deprecated_edges,
  count(*) FILTER (WHERE NOT deprecated AND created_at > {SQL_AS_OF} - interval '24' hour) AS edges_24h,
  count(*) FILTER (WHERE current_weight_band = 'strong') AS strong_edges,
  count(*) FILTER (WHERE current_weight_band = 'disputed') AS disputed_edges,
  count(*) FILTER (WHERE NOT deprecated AND current_weight_band {_HIGH}
    AND (last_disconfirmation_pass IS NULL
      OR last_disconfirmation_pass < {SQL_AS_OF} - interval '14' day)) AS stale_edges FROM edges)
, p AS (SELECT count(*) AS payloads_24h,
  count(*) FILTER (WHERE fetched_at > {SQL_AS_OF} - interval '4' hour) AS payloads_4h,
  count(*) FILTER (WHERE rejected_reason IS NOT NULL) AS payloads_rejected
  FROM checked WHERE fetched_at > {SQL_AS_OF} - interval '24' hour)
SELECT * FROM s, n, e, p""", "payloads", "signals", "condition_nodes", "edges"))
def pipeline_health(t):
    s = t["signals"].withColumn(
        "cluster_id", F.when(F.col("payload_id") % 3 == 0, F.col("payload_id"))
    )
    n = t["condition_nodes"].withColumn("deprecated", F.col("current_state") == "unknown")
    return health.pipeline_health(s, n, t["edges"], checked(t), now=AS_OF)


@query("batch_quality", duck(f"""
SELECT batch_id, count(*) AS n_events, count(*) FILTER (WHERE NOT rejected) AS n_applied,
  count(*) FILTER (WHERE rejected) AS n_rejected, min(applied_at) AS batch_start,
  count(DISTINCT event_id % 7) AS n_lenses,
  round(count(*) FILTER (WHERE rejected) / count(*), 3) AS rejection_rate
FROM events_log WHERE applied_at > {SQL_AS_OF} - interval '7' day GROUP BY batch_id
ORDER BY batch_start DESC, batch_id LIMIT 20""", "events_log"))
def batch_quality(t):
    return health.batch_quality(t["events_log"].withColumn("lens_id", F.col("event_id") % 7), now=AS_OF, limit=20)


@query("signal_flow", duck(f"""
, r AS (SELECT lens_id, CASE WHEN payload_id % 3 = 0 THEN payload_id END AS c FROM signals
  WHERE extracted_at >= {SQL_AS_OF} - interval '24' hour)
SELECT lens_id, count(*) AS n_signals, count(DISTINCT c) AS n_clusters FROM r GROUP BY lens_id
UNION ALL SELECT 'all', count(*), count(DISTINCT c) FROM r""", "signals"))
def signal_flow(t):
    s = t["signals"].withColumn(
        "cluster_id", F.when(F.col("payload_id") % 3 == 0, F.col("payload_id"))
    )
    return health.signal_flow(s, now=AS_OF)


@query("graph_totals", duck("""
SELECT count(*) AS n_nodes, count(DISTINCT name) FILTER (WHERE name IN ('plain item 5', 'nowhere'))
  AS names_found, (SELECT count(*) FROM edges WHERE NOT deprecated) AS n_live_edges,
  (SELECT count(DISTINCT name) FROM name_nodes) AS n_aliases FROM condition_nodes""",
    "condition_nodes", "edges", "name_nodes"))
def graph_totals(t):
    return health.graph_totals(
        t["condition_nodes"], t["edges"], t["name_nodes"].select("name").distinct(),
        ["plain item 5", "nowhere"],
    )


# --- sessions --------------------------------------------------------------------------------------------

@query("session_history", duck("""
SELECT session_id, message_no, role FROM messages
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at, message_no) <= 3""", "messages"))
def session_history(t):
    return sessions.history(t["messages"], 3).select("session_id", "message_no", "role")


@query("session_prune", duck("""
, s AS (SELECT session_id, count(*) AS n_messages, min(created_at) AS started_at,
  max(created_at) AS last_active FROM messages GROUP BY session_id)
SELECT s.*, (SELECT count(*) FROM messages m WHERE m.session_id = s.session_id) AS kept_messages
FROM s WHERE last_active >= timestamp '2024-01-05 00:00:00' - interval '48' hour""", "messages"))
def session_prune(t):
    s = sessions.sessions(t["messages"])
    kept, messages = sinks.prune_sessions(s, t["messages"], now=AS_OF.replace(day=5))
    n = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("kept_messages"))
    return kept.join(n, "session_id")


@query("daily_cap", duck("""
, r AS (SELECT call_id, coalesce(sum(cost_usd) OVER (PARTITION BY cast(ts AS date) ORDER BY ts, call_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM costs)
SELECT call_id, cast(b AS double) AS spent_before, b >= 5 AS refused FROM r""", "costs"))
def daily_cap(t):
    return sessions.daily_cap(t["costs"]).select(
        "call_id", F.col("spent_before").cast("double").alias("spent_before"), "refused"
    )


_QUOTA = """
, seq AS (SELECT call_id, key_id, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY key_id ORDER BY ts, call_id) AS r FROM costs)
, step AS (SELECT call_id, key_id, r, true AS allowed, [us] AS times, us FROM seq WHERE r = 1
  UNION ALL SELECT s.call_id, s.key_id, s.r,
    len(list_filter(p.times, lambda x: x >= s.us - 43200000000)) < 2,
    CASE WHEN len(list_filter(p.times, lambda x: x >= s.us - 43200000000)) < 2
      THEN list_append(list_filter(p.times, lambda x: x >= s.us - 43200000000), s.us)
      ELSE list_filter(p.times, lambda x: x >= s.us - 43200000000) END, s.us
  FROM step p JOIN seq s ON s.key_id = p.key_id AND s.r = p.r + 1)
SELECT call_id AS request_id, key_id, allowed, CASE WHEN allowed THEN 0
  ELSE (43200000000 - (us - times[1])) // 1000000 + 1 END AS retry_after FROM step"""


@query("quota", duck(_QUOTA, "costs", recursive=True))
def quota(t):
    r = t["costs"].select(F.col("call_id").alias("request_id"), "key_id", "ts")
    return sessions.quota(r, limit=2, window_seconds=43_200)
