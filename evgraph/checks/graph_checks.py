"""Queries on similarity, histories, the graph, its mutation and batches."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from evgraph.checks.registry import AS_OF, SQL_AS_OF, query
from evgraph.checks.tables import duck
from evgraph.operators import asof, components, mutate, similarity, traverse, vectors
from evgraph.plans import changes, reasoning, review, topics

SHIP_AS_OF = datetime(1998, 6, 1)
SQL_SHIP = "timestamp '1998-06-01 00:00:00'"


def grams(x: str) -> str:
    """Trigram set of a text in DuckDB."""
    return (
        f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({x}), "
        "'[^\\p{L}\\p{N}]+'), lambda w: length(w) > 0), lambda w: list_transform("
        "range(1, cast(length(w) + 2 AS bigint)), lambda i: substring('  ' || w || ' ', i, 3)))))"
    )


def ratio(a: str, b: str) -> str:
    """Jaccard ratio of two trigram lists in DuckDB."""
    both = f"len(list_intersect({a}, {b}))"
    return f"({both} / (len({a}) + len({b}) - {both}))"


# --- similarity -------------------------------------------------------------------------

@query("name_search", duck(f"""
, q AS (SELECT query, {grams('query')} AS g FROM (SELECT DISTINCT question AS query FROM questions) z)
, n AS (SELECT name, {grams('name')} AS g FROM (SELECT DISTINCT name FROM name_nodes) z)
, p AS (SELECT query, name, {ratio('q.g', 'n.g')} AS score FROM q, n)
SELECT query, node_id, name, round(score, 6) AS score FROM p JOIN name_nodes USING (name)
WHERE score > 0.1
QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, node_id) <= 20""",
    "questions", "name_nodes"))
def name_search(t):
    d = similarity.search_names(t["questions"], "question", t["name_nodes"])
    return d.select("query", "node_id", "name", F.round("score", 6).alias("score"))


def _aliases(t):
    return t["name_nodes"].groupBy(F.col("name").alias("alias_text")).agg(
        F.min("node_id").alias("canonical_node_id"), F.min("description").alias("canonical_name")
    )


@query("alias_candidates", duck(f"""
, a AS (SELECT name AS alias_text, min(node_id) AS canonical_node_id, {grams('name')} AS g
  FROM name_nodes GROUP BY name)
, q AS (SELECT query, {grams('query')} AS g FROM (SELECT DISTINCT p_name AS query FROM part) z)
SELECT query, alias_text, canonical_node_id, round({ratio('q.g', 'a.g')}, 6) AS score FROM q, a
WHERE {ratio('q.g', 'a.g')} >= 0.5
QUALIFY row_number() OVER (PARTITION BY query ORDER BY {ratio('q.g', 'a.g')} DESC, alias_text) <= 10""",
    "name_nodes"))
def alias_candidates(t):
    d = similarity.alias_candidates(t["part"], "p_name", _aliases(t))
    return d.select("query", "alias_text", "canonical_node_id", F.round("score", 6).alias("score"))


@query("edge_signals", duck(f"""
, s AS (SELECT signal_id, content_timestamp, {grams('claim_text')} AS g FROM shipment_signals
  WHERE content_timestamp > {SQL_SHIP} - interval '7' day AND content_timestamp <= {SQL_SHIP})
, e AS (SELECT name, {grams('name')} AS g FROM (SELECT source_name AS name FROM supply_edges
  UNION SELECT target_name FROM supply_edges) z)
, m AS (SELECT name, signal_id, content_timestamp FROM e, s WHERE {ratio('e.g', 's.g')} > 0.15)
, near AS (SELECT edge_id, signal_id, content_timestamp FROM supply_edges JOIN m ON name = source_name
  UNION SELECT edge_id, signal_id, content_timestamp FROM supply_edges JOIN m ON name = target_name)
, best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY edge_id
  ORDER BY content_timestamp DESC, signal_id DESC) <= 30)
SELECT edge_id, count(*) AS n_signals, min(signal_id) AS lowest, max(signal_id) AS highest,
  min(content_timestamp) AS oldest FROM best GROUP BY edge_id""", "shipment_signals", "supply_edges"))
def edge_signals(t):
    recent = t["shipment_signals"].filter(
        (F.col("content_timestamp") > F.lit(SHIP_AS_OF - timedelta(days=7)))
        & (F.col("content_timestamp") <= F.lit(SHIP_AS_OF))
    )
    d = similarity.signals_near_edges(t["supply_edges"], recent)
    return d.groupBy("edge_id").agg(
        F.count(F.lit(1)).alias("n_signals"), F.min("signal_id").alias("lowest"),
        F.max("signal_id").alias("highest"), F.min("content_timestamp").alias("oldest"),
    )


_QUESTION = f"""
, q AS (SELECT query, {grams('query')} AS g FROM (SELECT DISTINCT question AS query FROM questions) z)
, n AS (SELECT name, description, {grams('name')} AS g, {grams('description')} AS h
  FROM (SELECT DISTINCT name, description FROM name_nodes) z)
, p AS (SELECT query, name, description,
  greatest({ratio('q.g', 'n.g')}, {ratio('q.g', 'n.h')}) AS score FROM q, n)
, hit AS (SELECT query, node_id, name, score FROM p JOIN name_nodes USING (name, description)
  WHERE score > 0.1 OR contains(lower(name), lower(substring(query, 1, 40)))
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, node_id) <= 12)
"""


@query("question_nodes", duck(_QUESTION + """
SELECT query, node_id, round(score, 6) AS score FROM hit""", "questions", "name_nodes"))
def question_nodes(t):
    d = topics.question_nodes(t["questions"], t["name_nodes"])
    return d.select("query", "node_id", F.round("score", 6).alias("score"))


@query("question_edges", duck(_QUESTION + f"""
, e AS (SELECT DISTINCT query, edge_id, current_weight_band AS band, updated_at
  FROM hit JOIN supply_edges ON node_id = target_node_id OR node_id = source_node_id
  WHERE NOT deprecated AND created_at <= {SQL_SHIP})
SELECT query, edge_id, band FROM e QUALIFY row_number() OVER (PARTITION BY query ORDER BY
  CASE band WHEN 'strong' THEN 0 WHEN 'moderate' THEN 1 WHEN 'weak' THEN 2 ELSE 3 END,
  updated_at DESC, edge_id) <= 15""", "questions", "name_nodes", "supply_edges"))
def question_edges(t):
    hits = topics.question_nodes(t["questions"], t["name_nodes"])
    d = topics.question_edges(hits, t["supply_edges"], as_of=SHIP_AS_OF)
    return d.select("query", "edge_id", F.col("current_weight_band").alias("band"))


@query("question_signals", duck(_QUESTION + f"""
, term AS (SELECT DISTINCT query, lower(substring(name, 1, 30)) AS term FROM
  (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, node_id) <= 5) z)
, s AS (SELECT * FROM shipment_signals
  WHERE content_timestamp BETWEEN {SQL_SHIP} - interval '30' day AND {SQL_SHIP})
, m AS (SELECT DISTINCT query, signal_id, content_timestamp FROM term, s
  WHERE contains(lower(claim_text), term))
SELECT query, signal_id FROM m QUALIFY row_number() OVER (PARTITION BY query
  ORDER BY content_timestamp DESC, signal_id DESC) <= 10""",
    "questions", "name_nodes", "shipment_signals"))
def question_signals(t):
    hits = topics.question_nodes(t["questions"], t["name_nodes"])
    return topics.question_signals(
        hits, t["name_nodes"], t["shipment_signals"], as_of=SHIP_AS_OF
    ).select("query", "signal_id")


_MOMENT = datetime(1995, 6, 1)
_SQL_MOMENT = "timestamp '1995-06-01 00:00:00'"


def _then(history: str, key: str, value: str) -> str:
    """Newest value per key up to the moment."""
    return f"SELECT {key}, max_by({value}, (content_timestamp, id)) AS v FROM {history} WHERE content_timestamp <= {_SQL_MOMENT} GROUP BY {key}"


@query("question_context", duck(f"""
, pn AS (SELECT n.* REPLACE (coalesce(v, current_state) AS current_state) FROM part_nodes n
  LEFT JOIN ({_then('part_history', 'node_id', 'new_state')}) h USING (node_id) WHERE created_at <= {_SQL_MOMENT})
, se AS (SELECT e.* REPLACE (coalesce(v, current_weight_band) AS current_weight_band) FROM supply_edges e
  LEFT JOIN ({_then('delivery_history', 'edge_id', 'weight_band')}) h USING (edge_id) WHERE created_at <= {_SQL_MOMENT})
, q AS (SELECT query, {grams('query')} AS g FROM (SELECT DISTINCT question AS query FROM questions) z)
, n AS (SELECT name, d, {grams('name')} AS g, {grams('d')} AS h
  FROM (SELECT DISTINCT name, coalesce(description, '') AS d FROM pn) z)
, p AS (SELECT query, name, d, greatest({ratio('q.g', 'n.g')}, {ratio('q.g', 'n.h')}) AS score FROM q, n)
, hit AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node_id) AS pos
  FROM p JOIN (SELECT *, coalesce(description, '') AS d FROM pn) k USING (name, d)
  WHERE score > 0.1 OR contains(lower(name), lower(substring(query, 1, 40))) QUALIFY pos <= 12)
, e AS (SELECT DISTINCT query, se.* FROM hit JOIN se ON node_id = target_node_id OR node_id = source_node_id WHERE NOT deprecated)
, el AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY
  CASE current_weight_band WHEN 'strong' THEN 0 WHEN 'moderate' THEN 1 WHEN 'weak' THEN 2 ELSE 3 END,
  updated_at DESC, edge_id) AS pos FROM e QUALIFY pos <= 15)
, term AS (SELECT DISTINCT query, lower(substring(name, 1, 30)) AS term FROM hit WHERE pos <= 5)
, m AS (SELECT DISTINCT query, s.* FROM term, shipment_signals s
  WHERE content_timestamp BETWEEN {_SQL_MOMENT} - interval '30' day AND {_SQL_MOMENT} AND contains(lower(claim_text), term))
, sl AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY content_timestamp DESC, signal_id DESC) AS pos FROM m QUALIFY pos <= 10)
SELECT query, 'node' AS part, pos AS position, node_id AS item_id, node_type AS kind, name AS label, NULL::varchar AS other,
  current_state AS state, d AS detail, created_at AS at FROM hit
UNION ALL SELECT query, 'edge', pos, edge_id::varchar, 'supplies', source_name, target_name, current_weight_band,
  substring('delivered by ' || source_name, 1, 200), created_at FROM el
UNION ALL SELECT query, 'signal', pos, signal_id::varchar, 'physical_world', substring(claim_text, 1, 300), NULL, 'hard_datum', '',
  content_timestamp FROM sl
UNION ALL SELECT NULL, 'dimension', 1, NULL, NULL, dimension, count(*)::varchar, (count(*) FILTER (WHERE current_state = 'active'))::varchar,
  '', {_SQL_MOMENT} FROM pn WHERE node_type = 'condition' AND dimension IS NOT NULL GROUP BY dimension""",
    "questions", "part_nodes", "part_history", "delivery_history", "supply_edges", "shipment_signals"))
def question_context(t):
    """All four parts at a moment with states and bands of then; later parts and deliveries do not exist yet."""
    edges = t["supply_edges"].withColumns({"edge_type": F.lit("supplies"), "reasoning": F.concat(F.lit("delivered by "), "source_name")})
    told = t["shipment_signals"].withColumns({"lens_id": F.lit("physical_world"), "confidence_band": F.lit("hard_datum")})
    return topics.question_context(t["questions"], t["part_nodes"], edges, told, as_of=_MOMENT,
                                   state_history=t["part_history"], weight_history=t["delivery_history"])


# --- histories ---------------------------------------------------------------------------

@query("weight_as_of", duck(f"""
SELECT edge_id, arg_max(weight_band, (content_timestamp, id)) AS weight_band FROM edge_history
WHERE content_timestamp <= {SQL_AS_OF} GROUP BY edge_id""", "edge_history"))
def weight_as_of(t):
    return asof.value_as_of(t["edge_history"], "edge_id", "weight_band", AS_OF)


@query("state_as_of", duck(f"""
SELECT n.node_id, coalesce(h.s, n.current_state) AS current_state FROM condition_nodes n
LEFT JOIN (SELECT node_id, arg_max(new_state, (content_timestamp, id)) AS s FROM condition_history
  WHERE content_timestamp <= {SQL_AS_OF} GROUP BY node_id) h ON h.node_id = n.node_id
WHERE n.created_at <= {SQL_AS_OF}""", "condition_nodes", "condition_history"))
def state_as_of(t):
    return asof.nodes_as_of(t["condition_nodes"], t["condition_history"], AS_OF).select(
        "node_id", "current_state"
    )


@query("edges_as_of", duck(f"""
SELECT e.edge_id, coalesce(h.b, e.current_weight_band) AS current_weight_band FROM edges e
LEFT JOIN (SELECT edge_id, arg_max(weight_band, (content_timestamp, id)) AS b FROM edge_history
  WHERE content_timestamp <= {SQL_AS_OF} GROUP BY edge_id) h ON h.edge_id = e.edge_id
WHERE e.created_at <= {SQL_AS_OF}""", "edges", "edge_history"))
def edges_as_of(t):
    return asof.edges_as_of(t["edges"], t["edge_history"], AS_OF).select(
        "edge_id", "current_weight_band"
    )


@query("edge_history", duck("""
SELECT * FROM edge_history
QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY content_timestamp DESC, id DESC) <= 5""",
    "edge_history"))
def edge_history(t):
    return asof.recent_history(t["edge_history"], "edge_id", 5)


@query("state_changes", duck("""
SELECT id, node_id, new_state, lag(new_state) OVER (PARTITION BY node_id ORDER BY content_timestamp, id)
  AS previous_state FROM condition_history""", "condition_history"))
def state_changes(t):
    d = changes.with_previous(t["condition_history"], "node_id", "new_state", "previous_state")
    return d.select("id", "node_id", "new_state", "previous_state")


@query("node_page", duck(f"""
SELECT node_id, created_at FROM condition_nodes WHERE created_at <= {SQL_AS_OF}
ORDER BY created_at DESC, node_id LIMIT 10 OFFSET 5""", "condition_nodes"))
def node_page(t):
    return asof.nodes_of_type(
        t["condition_nodes"], "condition", as_of=AS_OF, limit=10, offset=5
    ).select("node_id", "created_at")


@query("edges_of_node", duck("""
SELECT n.node_id, count(*) AS n_edges, count(*) FILTER (WHERE edge_type = 'causes') AS n_causes
FROM condition_nodes n JOIN edges e ON e.source_node_id = n.node_id OR e.target_node_id = n.node_id
WHERE NOT e.deprecated GROUP BY n.node_id""", "condition_nodes", "edges"))
def edges_of_node(t):
    d = asof.edges_of_nodes(t["edges"], t["condition_nodes"])
    return d.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("edge_type") == "causes").alias("n_causes")
    )


@query("node_drill", duck(f"""
, e AS (SELECT n.node_id, 'edge' AS kind, e.edge_id AS item, concat(s.name, ' > ', d.name) AS label,
    CASE e.current_weight_band WHEN 'strong' THEN 0 WHEN 'moderate' THEN 1 WHEN 'weak' THEN 2
      WHEN 'provisional' THEN 3 ELSE 4 END AS ord
  FROM condition_nodes n JOIN edges e ON e.source_node_id = n.node_id OR e.target_node_id = n.node_id
  JOIN condition_nodes s ON s.node_id = e.source_node_id
  JOIN condition_nodes d ON d.node_id = e.target_node_id
  WHERE NOT e.deprecated AND e.created_at <= {SQL_AS_OF})
, h AS (SELECT node_id, 'state' AS kind, cast(id AS varchar) AS item, new_state AS label, 0 AS ord
  FROM condition_history WHERE content_timestamp <= {SQL_AS_OF}
  QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY content_timestamp DESC, id DESC) <= 20)
SELECT * FROM e UNION ALL SELECT * FROM h""", "condition_nodes", "edges", "condition_history"))
def node_drill(t):
    d = reasoning.node_drilldown(
        t["condition_nodes"], t["edges"], t["condition_history"], t["condition_nodes"], as_of=AS_OF
    )
    e = d["edges"].select(
        "node_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("item"),
        F.concat_ws(" > ", "source_name", "target_name").alias("label"), F.col("band_ord").alias("ord"),
    )
    s = d["states"].select(
        "node_id", F.lit("state").alias("kind"), F.col("id").cast("string").alias("item"),
        F.col("new_state").alias("label"), F.lit(0).alias("ord"),
    )
    return e.unionAll(s)


_SUPPORT = """
, support AS (SELECT DISTINCT l.target_edge_id AS edge_id, t.signal_id, l.event_id % 2 = 0 AS supporting
  FROM events_log l JOIN event_triggers t ON t.event_id = l.event_id WHERE NOT l.rejected)
"""


def _support(t):
    return (
        t["events_log"].filter("NOT rejected").join(t["event_triggers"], "event_id")
        .select(F.col("target_edge_id").alias("edge_id"), "signal_id",
                (F.col("event_id") % 2 == 0).alias("supporting")).distinct()
    )


@query("edge_drill", duck(_SUPPORT + f"""
, e AS (SELECT edge_id FROM edges WHERE created_at <= {SQL_AS_OF} AND NOT deprecated)
, w AS (SELECT edge_id, 'weight' AS kind, cast(id AS varchar) AS item, weight_band AS label
  FROM edge_history JOIN e USING (edge_id) WHERE content_timestamp <= {SQL_AS_OF}
  QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY content_timestamp DESC, id DESC) <= 30)
, c AS (SELECT edge_id, 'challenge' AS kind, cast(pass_event_id AS varchar) AS item, outcome AS label
  FROM challenges JOIN e USING (edge_id)
  QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY challenged_at DESC, pass_event_id DESC) <= 10)
, s AS (SELECT edge_id, CASE WHEN supporting THEN 'for' ELSE 'against' END AS kind,
    cast(signal_id AS varchar) AS item, p.source_id AS label
  FROM support JOIN e USING (edge_id) JOIN signals g USING (signal_id)
  LEFT JOIN payloads p USING (payload_id)
  QUALIFY row_number() OVER (PARTITION BY edge_id, supporting
    ORDER BY g.content_timestamp DESC, signal_id DESC) <= 20)
SELECT * FROM w UNION ALL SELECT * FROM c UNION ALL SELECT * FROM s""",
    "edges", "edge_history", "challenges", "events_log", "event_triggers", "signals", "payloads"))
def edge_drill(t):
    wanted = t["edges"].filter((F.col("created_at") <= F.lit(AS_OF)) & ~F.col("deprecated"))
    d = reasoning.edge_drilldown(
        t["condition_nodes"], t["edges"], t["edge_history"], t["challenges"], _support(t), t["signals"],
        t["payloads"], wanted, as_of=AS_OF,
    )

    def part(name, kind, item, label):
        return d[name].select("edge_id", F.lit(kind).alias("kind"),
                              F.col(item).cast("string").alias("item"), F.col(label).alias("label"))

    return (
        part("weights", "weight", "id", "weight_band")
        .unionAll(part("challenges", "challenge", "pass_event_id", "outcome"))
        .unionAll(part("supporting", "for", "signal_id", "source_id"))
        .unionAll(part("disconfirming", "against", "signal_id", "source_id"))
    )


# --- traversal -----------------------------------------------------------------------------

@query("degree", duck("""
SELECT node_id, count(*) AS degree FROM (SELECT source_node_id AS node_id FROM large_edges
UNION ALL SELECT target_node_id FROM large_edges) z GROUP BY node_id""", "large_edges"))
def degree(t):
    return traverse.degree(t["large_edges"])


@query("blast_radius", duck("""
, inc AS (SELECT edge_id, source_node_id AS n FROM edges WHERE NOT deprecated
  UNION ALL SELECT edge_id, target_node_id FROM edges WHERE NOT deprecated)
SELECT e.edge_id, (SELECT count(DISTINCT i.edge_id) FROM inc i WHERE i.edge_id <> e.edge_id
  AND (i.n = e.source_node_id OR i.n = e.target_node_id)) AS blast_radius FROM edges e""", "edges"))
def blast_radius(t):
    return traverse.blast_radius(t["edges"])


@query("blast_radius_large", duck("""
, d AS (SELECT n, count(*) AS c FROM (SELECT source_node_id AS n FROM large_edges
  UNION ALL SELECT target_node_id FROM large_edges) z GROUP BY n)
SELECT e.edge_id, a.c + b.c - 2 AS blast_radius FROM large_edges e
JOIN d a ON a.n = e.source_node_id JOIN d b ON b.n = e.target_node_id""", "large_edges"))
def blast_radius_large(t):
    return traverse.blast_radius(t["large_edges"])


def _roots(t):
    """The best connected member of each topic."""
    d = t["topic_nodes"].join(traverse.degree(t["edges"]), "node_id")
    return d.groupBy("topic_id").agg(
        F.max_by("node_id", F.struct("degree", "node_id")).alias("root")
    ).select("root").distinct()


@query("neighbourhood", duck("""
, ends AS (SELECT source_node_id AS a, target_node_id AS b, edge_id FROM edges WHERE NOT deprecated
  UNION ALL SELECT target_node_id, source_node_id, edge_id FROM edges WHERE NOT deprecated)
, deg AS (SELECT a AS node_id, count(*) AS degree FROM ends GROUP BY a)
, roots AS (SELECT DISTINCT arg_max(node_id, (degree, node_id)) AS root
  FROM topic_nodes JOIN deg USING (node_id) GROUP BY topic_id)
, near AS (SELECT root, root AS node_id, 0 AS distance FROM roots
  UNION SELECT root, b, 1 FROM roots JOIN ends ON a = root WHERE b <> root)
, found AS (SELECT DISTINCT root, edge_id FROM near JOIN ends ON a = node_id)
SELECT root, 'node' AS kind, node_id AS item, distance FROM near
UNION ALL SELECT root, 'edge', edge_id, -1 FROM found""", "edges", "topic_nodes"))
def neighbourhood(t):
    nodes, found = traverse.neighbourhood(t["edges"], _roots(t), depth=2)
    return nodes.select("root", F.lit("node").alias("kind"), F.col("node_id").alias("item"),
                        "distance").unionAll(
        found.select("root", F.lit("edge").alias("kind"), F.col("edge_id").alias("item"),
                     F.lit(-1).alias("distance"))
    )


@query("context_pack", duck("""
, l AS (SELECT topic_id, node_id, created_at, length(concat('- [', node_type, '] **', name, '** (id=',
    node_id, ')')) + 1 AS n FROM topic_nodes JOIN condition_nodes USING (node_id))
, r AS (SELECT *, sum(n) OVER (PARTITION BY topic_id ORDER BY created_at, node_id) AS used FROM l)
SELECT topic_id, node_id, cast(used AS bigint) AS used FROM r WHERE used - n <= 600""",
    "topic_nodes", "condition_nodes"))
def context_pack(t):
    d = t["topic_nodes"].join(t["condition_nodes"], "node_id").withColumn(
        "line", F.concat(F.lit("- ["), "node_type", F.lit("] **"), "name", F.lit("** (id="),
                         "node_id", F.lit(")"))
    )
    return traverse.pack_lines(
        d, key="topic_id", order=["created_at", "node_id"],
        bucket=F.date_trunc("hour", "created_at"), budget=600,
    ).select("topic_id", "node_id", "used")


@query("context_roots", duck(f"""
, names AS (SELECT batch_id, pos AS name_no, lower(name) AS name FROM operations
  WHERE operation = 'create_node' AND trim(name) <> '')
, a AS (SELECT name, {grams('name')} AS g FROM (SELECT DISTINCT name FROM names) z)
, b AS (SELECT node_id, {grams('name')} AS g FROM condition_nodes)
, m AS (SELECT name, node_id, {ratio('a.g', 'b.g')} AS score FROM a, b WHERE {ratio('a.g', 'b.g')} > 0.1
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY {ratio('a.g', 'b.g')} DESC, node_id) <= 2)
, f AS (SELECT batch_id, node_id, min(name_no) AS name_no FROM names JOIN m USING (name) GROUP BY ALL)
, c AS (SELECT batch_id, name_no, count(*) AS n FROM f GROUP BY ALL)
, h AS (SELECT *, sum(n) OVER (PARTITION BY batch_id ORDER BY name_no) - n AS before FROM c)
SELECT f.batch_id, f.node_id, f.name_no FROM f JOIN h USING (batch_id, name_no) WHERE before < 6""",
    "operations", "condition_nodes"))
def context_roots(t):
    names = t["operations"].filter("operation = 'create_node' AND trim(name) <> ''").select(
        "batch_id", F.col("pos").alias("name_no"), F.lower("name").alias("name")
    )
    hits = similarity.search_names(names, "name", t["condition_nodes"], k=2)
    hits = hits.select(F.col("query").alias("name"), "node_id", "score")
    return traverse.context_roots(names, hits)


@query("projection_paths", duck("""
, step AS (SELECT source_node_id AS a, target_node_id AS b, falsification_criteria AS f,
    CASE current_weight_band WHEN 'strong' THEN 0.8 WHEN 'moderate' THEN 0.6 WHEN 'weak' THEN 0.4
      WHEN 'provisional' THEN 0.2 END AS w FROM edges WHERE NOT deprecated)
, one AS (SELECT a AS start, b AS stop, 1 AS hops, coalesce(w, 1.0) AS s, w AS weakest,
    w IS NULL AS disputed, CASE WHEN f <> '' THEN 1 ELSE 0 END AS n_f
  FROM step JOIN condition_nodes ON node_id = a WHERE current_state = 'active')
, two AS (SELECT start, b AS stop, 2 AS hops, s * coalesce(w, 1.0) AS s, least(weakest, w) AS weakest,
    disputed OR w IS NULL AS disputed, n_f + CASE WHEN f <> '' THEN 1 ELSE 0 END AS n_f
  FROM one JOIN step ON a = stop WHERE b <> start AND b <> stop)
, three AS (SELECT t.start, b AS stop, 3 AS hops, s * coalesce(w, 1.0) AS s, least(weakest, w) AS weakest,
    disputed OR w IS NULL AS disputed, n_f + CASE WHEN f <> '' THEN 1 ELSE 0 END AS n_f
  FROM (SELECT o.start, o.stop AS mid, k.b AS stop, o.s * coalesce(k.w, 1.0) AS s, least(o.weakest, k.w) AS weakest,
      o.disputed OR k.w IS NULL AS disputed, o.n_f + CASE WHEN k.f <> '' THEN 1 ELSE 0 END AS n_f
    FROM one o JOIN step k ON k.a = o.stop WHERE k.b <> o.start AND k.b <> o.stop) t
  JOIN step ON a = t.stop WHERE b <> t.start AND b <> t.mid AND b <> t.stop)
SELECT start, hops, count(*) AS n_paths, count(DISTINCT stop) AS n_ends,
  round(cast(max(s) AS double), 6) AS best, round(cast(sum(s) AS double), 6) AS total,
  cast(min(weakest) AS double) AS weakest, count(*) FILTER (WHERE disputed) AS n_disputed,
  cast(sum(n_f) AS bigint) AS n_falsifiers
FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three) z
GROUP BY start, hops""",
    "edges", "condition_nodes"))
def projection_paths(t):
    starts = t["condition_nodes"].filter("current_state = 'active'")
    d = traverse.projection_totals(t["edges"], starts, depth=3)
    return d.withColumns({c: F.round(c, 6) for c in ("best", "total")})


@query("reference_cycles", duck("""
, r AS (SELECT DISTINCT batch_id, lower(source_ref) AS a, lower(target_ref) AS b FROM operations
  WHERE operation = 'create_edge')
, walk AS (SELECT batch_id, a, b, 1 AS n FROM r
  UNION SELECT w.batch_id, w.a, r.b, n + 1 FROM walk w JOIN r ON r.batch_id = w.batch_id AND r.a = w.b
  WHERE n < 25 AND w.a <> w.b)
SELECT DISTINCT batch_id, a AS slug FROM walk WHERE a = b""", "operations", recursive=True))
def reference_cycles(t):
    refs = t["operations"].filter("operation = 'create_edge'").select(
        "batch_id", F.lower("source_ref").alias("source_ref"), F.lower("target_ref").alias("target_ref")
    )
    return traverse.reference_cycles(refs)


# --- grouping ---------------------------------------------------------------------------------

_GROUPS = """
, names AS (SELECT DISTINCT signal_id, lower(trim(name)) AS name FROM signal_entities)
, link AS (SELECT DISTINCT x.name AS a, y.name AS b FROM names x JOIN names y USING (signal_id))
, reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
, root AS (SELECT a AS name, min(b) AS root FROM reach GROUP BY a)
, member AS (SELECT DISTINCT signal_id, root FROM names JOIN root USING (name))
, grp AS (SELECT root, min(signal_id) AS group_id FROM member JOIN signals USING (signal_id) GROUP BY root)
, grouped AS (SELECT s.*, coalesce(g.group_id, s.signal_id) AS group_id FROM signals s
  LEFT JOIN member m ON m.signal_id = s.signal_id LEFT JOIN grp g ON g.root = m.root)
"""


@query("components", duck(_GROUPS + "SELECT signal_id, group_id FROM grouped",
                          "signals", "signal_entities", recursive=True))
def signal_groups(t):
    return components.group_signals(t["signals"], t["signal_entities"]).select("signal_id", "group_id")


@query("batches", duck(_GROUPS + f"""
, w AS (SELECT *, floor((row_number() OVER (PARTITION BY group_id
    ORDER BY content_timestamp DESC, signal_id) - 1) / 20) AS batch_no FROM grouped WHERE NOT anchored)
SELECT group_id, cast(batch_no AS bigint) AS batch_no, count(*) AS n_signals,
  array_to_string(list_sort(list(DISTINCT lens_id)), '|') AS lens_ids,
  min(content_timestamp) AS content_timestamp, min(extracted_at) AS oldest_extracted_at
FROM w GROUP BY group_id, batch_no
HAVING count(*) >= 2 OR epoch({SQL_AS_OF} - min(extracted_at)) >= 6 * 3600""",
    "signals", "signal_entities", recursive=True))
def batches(t):
    grouped = components.group_signals(t["signals"], t["signal_entities"]).filter("NOT anchored")
    return components.batch_summary(components.form_batches(grouped, now=AS_OF, max_hold_hours=6.0))


@query("vector_clusters", duck("""
, pair AS (SELECT x.signal_id AS a, y.signal_id AS b FROM claim_vectors x JOIN claim_vectors y
  ON x.lens_no = y.lens_no AND (x.signal_id = y.signal_id
    OR list_cosine_similarity(cast(x.vector AS double[]), cast(y.vector AS double[])) > 0.35))
, reach AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON p.a = r.b)
SELECT a AS signal_id, min(b) AS cluster_id FROM reach GROUP BY a""", "claim_vectors", recursive=True))
def vector_clusters(t):
    return vectors.cluster_vectors(t["claim_vectors"], above=0.35).select("signal_id", "cluster_id")


# --- mutation -----------------------------------------------------------------------------------

_EVENTS = """
, o AS (SELECT *, lower(proposed_id) AS slug, lower(trim(name)) AS akey, CASE
    WHEN operation <> 'create_node' THEN NULL
    WHEN node_type = 'galaxy' THEN 'unknown node_type'
    WHEN trim(name) = '' THEN 'create_node requires a non-empty name in fields'
    WHEN node_type = 'entity' AND entity_kind IS NULL THEN 'Entity node requires entity_kind in fields'
  END AS why FROM operations)
, c AS (SELECT *, CASE WHEN node_type = 'entity' THEN first_value(batch_id * 100 + pos) OVER (
    PARTITION BY akey, node_type ORDER BY content_timestamp, lpad(batch_id::varchar, 1, ''), pos)
    ELSE batch_id * 100 + pos END AS owner
  FROM o WHERE operation = 'create_node' AND why IS NULL)
, e AS (SELECT o.*, s.owner AS src, d.owner AS dst, CASE
    WHEN o.edge_type = 'influences' THEN 'unknown edge_type'
    WHEN o.weight_band = 'huge' THEN 'unknown weight_band'
    WHEN trim(o.falsification_criteria) = '' THEN 'falsification_criteria is required on create_edge'
    WHEN s.owner IS NULL THEN 'source_node_id could not be resolved'
    WHEN d.owner IS NULL THEN 'target_node_id could not be resolved'
    WHEN s.owner = d.owner THEN 'source_node_id and target_node_id are the same' END AS ewhy
  FROM o LEFT JOIN c s ON s.batch_id = o.batch_id AND s.slug = o.source_ref
  LEFT JOIN c d ON d.batch_id = o.batch_id AND d.slug = o.target_ref WHERE o.operation = 'create_edge')
, ev AS (SELECT o.batch_id, o.pos, CASE WHEN c.owner <> o.batch_id * 100 + o.pos
      THEN 'create_node_aliased' ELSE 'create_node' END AS event_type, o.why AS rejection_reason
    FROM o LEFT JOIN c ON c.batch_id = o.batch_id AND c.pos = o.pos WHERE o.operation = 'create_node'
  UNION ALL SELECT batch_id, pos, 'create_edge', ewhy FROM e)
""".replace("lpad(batch_id::varchar, 1, '')", "batch_id")


def _operations(t):
    o = t["operations"]
    fields = F.map_from_entries(F.filter(
        F.array(F.struct(F.lit("name").alias("k"), F.col("name").alias("v")),
                F.struct(F.lit("entity_kind").alias("k"), F.col("entity_kind").alias("v"))),
        lambda e: e["v"].isNotNull(),
    ))
    return o.select(
        F.col("batch_id"), F.col("content_timestamp").alias("batch_time"), "pos", "operation",
        "proposed_id", "node_type", F.when(F.col("operation") == "create_node", fields).alias("fields"),
        "source_ref", "target_ref", "edge_type", "weight_band", "falsification_criteria",
        F.lit("anchoring").alias("source"),
    )


def graph_events(t):
    """Validated events of all operations."""
    return mutate.validate(_operations(t), mutate.empty_graph(t.spark))


@query("apply_events", duck(_EVENTS + """
SELECT batch_id, pos, event_type, rejection_reason IS NOT NULL AS rejected, rejection_reason FROM ev""",
    "operations"))
def apply_events(t):
    return graph_events(t).select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "pos", "event_type", "rejected",
        "rejection_reason",
    )


@query("batch_totals", duck(_EVENTS + """
SELECT batch_id, count(*) FILTER (WHERE rejection_reason IS NULL) AS n_applied,
  count(*) FILTER (WHERE rejection_reason IS NOT NULL) AS n_rejected,
  round(count(*) FILTER (WHERE rejection_reason IS NOT NULL) / count(*), 6) AS rejection_rate
FROM ev GROUP BY batch_id""", "operations"))
def batch_totals(t):
    return mutate.batch_totals(graph_events(t)).withColumn(
        "batch_id", F.col("batch_id").cast("bigint")
    ).withColumn("rejection_rate", F.round("rejection_rate", 6))


@query("cycle_totals", duck(_EVENTS + """
SELECT count(DISTINCT batch_id) AS n_batches, count(*) AS n_signals_processed,
  count(*) FILTER (WHERE rejection_reason IS NULL) AS n_applied,
  count(*) FILTER (WHERE rejection_reason IS NOT NULL) AS n_rejected FROM ev""", "operations"))
def cycle_totals(t):
    sizes = t["operations"].groupBy(F.col("batch_id").cast("string").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n_signals")
    )
    return mutate.cycle_totals(graph_events(t), sizes)


def _hash_id(kind: str, batch: str, op: str, pos: str) -> str:
    event = f"sha256(concat('event|', {batch}, '|', '{op}', '|', {pos}))"
    return f"sha256(concat('{kind}|', {event}))"


@query("fold_nodes", duck(_EVENTS + f"""
SELECT {_hash_id('node', 'batch_id', 'create_node', 'pos')} AS node_id, node_type, trim(name) AS name,
  entity_kind, content_timestamp AS created_at FROM c WHERE owner = batch_id * 100 + pos""", "operations"))
def fold_nodes(t):
    d = mutate.fold_nodes(graph_events(t), mutate.empty_graph(t.spark).nodes)
    return d.select("node_id", "node_type", "name",
                    F.try_element_at("type_data", F.lit("entity_kind")).alias("entity_kind"), "created_at")


@query("fold_edges", duck(_EVENTS + f"""
SELECT {_hash_id('edge', 'batch_id', 'create_edge', 'pos')} AS edge_id,
  {_hash_id('node', '(src // 100)', 'create_node', '(src % 100)')} AS source_node_id,
  {_hash_id('node', '(dst // 100)', 'create_node', '(dst % 100)')} AS target_node_id,
  edge_type, weight_band AS current_weight_band FROM e WHERE ewhy IS NULL""", "operations"))
def fold_edges(t):
    d = mutate.fold_edges(graph_events(t), mutate.empty_graph(t.spark).edges)
    return d.select("edge_id", "source_node_id", "target_node_id", "edge_type", "current_weight_band")


@query("alias_fold", duck(_EVENTS + f"""
, held AS (SELECT DISTINCT concat('entity ', cast(c_custkey % 90 AS varchar)) AS alias_text,
  concat('Entity ', cast((c_custkey + 1) % 90 AS varchar)) AS canonical_name FROM customer)
, made AS (SELECT trim(name) AS name, {_hash_id('node', 'batch_id', 'create_node', 'pos')} AS node_id
  FROM c WHERE owner = batch_id * 100 + pos AND node_type = 'entity')
SELECT h.alias_text, h.canonical_name, m.node_id AS canonical_node_id FROM held h
LEFT JOIN made m ON m.name = h.canonical_name
UNION ALL SELECT name, name, node_id FROM made""", "operations"))
def alias_fold(t):
    held = t["customer"].selectExpr(
        "concat('entity ', cast(c_custkey % 90 AS string)) AS alias_text",
        "concat('Entity ', cast((c_custkey + 1) % 90 AS string)) AS canonical_name",
        "cast(NULL AS string) AS canonical_node_id",
    ).distinct()
    return mutate.fold_aliases(graph_events(t), held)


_WEIGH = """
, w AS (SELECT o.*, e.edge_id, e.current_weight_band AS stored, CASE
    WHEN operation = 'update_edge_weight' AND new_weight_band = 'vast' THEN 'unknown weight_band'
    WHEN e.edge_id IS NULL THEN 'target_edge_id could not be resolved'
    WHEN operation = 'update_edge_weight' AND e.deprecated THEN 'target edge is deprecated' END AS why
  FROM weight_operations o LEFT JOIN edges e ON e.edge_id = o.target_edge_id)
"""


def _weight_events(t):
    o = t["weight_operations"].select(
        F.lpad(F.col("batch_id").cast("string"), 12, "0").alias("batch_id"),
        F.col("content_timestamp").alias("batch_time"), "pos", "operation", "target_edge_id",
        "new_weight_band", "direction", F.col("signal_id").cast("string").alias("signal_id"),
        F.lit("anchoring").alias("source"),
    )
    g = mutate.empty_graph(t.spark)
    g.edges = t["edges"]
    return mutate.validate(o, g, id_pattern=r"^\S+$")


@query("weight_events", duck(_WEIGH + """
SELECT batch_id, pos, operation AS event_type, why AS rejection_reason FROM w""",
    "weight_operations", "edges"))
def weight_events(t):
    return _weight_events(t).select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "pos", "event_type", "rejection_reason"
    )


@query("weight_fold", duck(_WEIGH + """
, g AS (SELECT edge_id, arg_max(new_weight_band, (content_timestamp, batch_id, pos))
    FILTER (WHERE operation = 'update_edge_weight') AS band,
  count(*) FILTER (WHERE operation = 'add_supporting_signal') AS s,
  count(*) FILTER (WHERE operation = 'add_disconfirming_signal') AS d FROM w WHERE why IS NULL GROUP BY 1)
SELECT e.edge_id, coalesce(g.band, e.current_weight_band) AS current_weight_band,
  coalesce(s, 0) AS n_supporting, coalesce(d, 0) AS n_disconfirming
FROM edges e LEFT JOIN g ON g.edge_id = e.edge_id""", "weight_operations", "edges"))
def weight_fold(t):
    return mutate.fold_edges(_weight_events(t), t["edges"]).select(
        "edge_id", "current_weight_band", "n_supporting", "n_disconfirming"
    )


@query("weight_changes", duck(_WEIGH + """
SELECT edge_id, new_weight_band AS weight_band,
  coalesce(lag(new_weight_band) OVER (PARTITION BY edge_id ORDER BY content_timestamp, batch_id, pos),
    stored) AS previous_weight_band,
  CASE direction WHEN 'strengthen' THEN 'strengthened' ELSE 'weakened' END AS change_type,
  content_timestamp FROM w WHERE why IS NULL AND operation = 'update_edge_weight'""",
    "weight_operations", "edges"))
def weight_changes(t):
    return mutate.weight_history(_weight_events(t), t["edges"]).select(
        "edge_id", "weight_band", "previous_weight_band", "change_type", "content_timestamp"
    )


# --- challenges ----------------------------------------------------------------------------------

@query("challenge_candidates", duck(f"""
SELECT edge_id, s.name AS source_name, d.name AS target_name, current_weight_band FROM edges e
JOIN condition_nodes s ON s.node_id = e.source_node_id JOIN condition_nodes d ON d.node_id = e.target_node_id
WHERE NOT e.deprecated AND falsification_criteria <> '' AND current_weight_band IN ('strong', 'moderate')
  AND (last_disconfirmation_pass IS NULL OR last_disconfirmation_pass < {SQL_AS_OF} - interval '7' day)
ORDER BY CASE current_weight_band WHEN 'strong' THEN 1 ELSE 2 END,
  last_disconfirmation_pass ASC NULLS FIRST, e.updated_at DESC, edge_id LIMIT 20""",
    "edges", "condition_nodes"))
def challenge_candidates(t):
    return review.challenge_candidates(t["edges"], t["condition_nodes"], now=AS_OF, limit=20).select(
        "edge_id", "source_name", "target_name", "current_weight_band"
    )


@query("challenge_candidates_all", duck(f"""
SELECT edge_id, s.name AS source_name, d.name AS target_name, current_weight_band FROM edges e
JOIN condition_nodes s ON s.node_id = e.source_node_id JOIN condition_nodes d ON d.node_id = e.target_node_id
WHERE NOT e.deprecated AND falsification_criteria <> '' AND current_weight_band IN ('strong', 'moderate')
  AND (last_disconfirmation_pass IS NULL OR last_disconfirmation_pass < {SQL_AS_OF} - interval '7' day)""",
    "edges", "condition_nodes"))
def challenge_candidates_all(t):
    return review.challenge_candidates(t["edges"], t["condition_nodes"], now=AS_OF).select(
        "edge_id", "source_name", "target_name", "current_weight_band"
    )


@query("inline_edges", duck("""
SELECT edge_id, s.name AS source_name, d.name AS target_name FROM edges e
JOIN condition_nodes s ON s.node_id = e.source_node_id JOIN condition_nodes d ON d.node_id = e.target_node_id
WHERE NOT e.deprecated AND falsification_criteria <> '' AND current_weight_band IN ('strong', 'moderate')
ORDER BY e.updated_at DESC, edge_id LIMIT 30""", "edges", "condition_nodes"))
def inline_edges(t):
    return review.inline_edges(t["edges"], t["condition_nodes"], limit=30).select(
        "edge_id", "source_name", "target_name"
    )


@query("challenge_totals", duck("""
SELECT count(*) AS n_challenged, count(*) FILTER (WHERE outcome = 'found') AS n_found,
  count(*) FILTER (WHERE outcome = 'not_found') AS n_not_found,
  count(*) FILTER (WHERE outcome = 'error') AS n_error FROM challenges""", "challenges"))
def challenge_totals(t):
    return review.challenge_totals(t["challenges"])


@query("challenge_pass_totals", duck("""
, o AS (SELECT rejected FROM events_log JOIN challenges ON pass_event_id = event_id WHERE outcome = 'found')
SELECT count(*) AS n_challenged, count(*) FILTER (WHERE outcome = 'found') AS n_found,
  count(*) FILTER (WHERE outcome = 'not_found') AS n_not_found,
  count(*) FILTER (WHERE outcome = 'error') AS n_error,
  (SELECT count(*) FROM o WHERE NOT rejected) AS n_operations_applied,
  (SELECT count(*) FROM o WHERE rejected) AS n_operations_rejected FROM challenges""", "challenges", "events_log"))
def challenge_pass_totals(t):
    found = t["challenges"].filter("outcome = 'found'").select(F.col("pass_event_id").alias("event_id"))
    return review.challenge_totals(t["challenges"], t["events_log"].join(found, "event_id"))


@query("challenge_log", duck("""
SELECT pass_event_id, edge_id, s.name AS source_name, d.name AS target_name FROM challenges
JOIN edges e USING (edge_id) JOIN condition_nodes s ON s.node_id = e.source_node_id
JOIN condition_nodes d ON d.node_id = e.target_node_id WHERE outcome = 'found'
ORDER BY challenged_at DESC, pass_event_id DESC LIMIT 20""", "challenges", "edges", "condition_nodes"))
def challenge_log(t):
    return review.challenge_log(
        t["challenges"], t["edges"], t["condition_nodes"], outcome="found", limit=20
    ).select("pass_event_id", "edge_id", "source_name", "target_name")


@query("edge_survival", duck("""
SELECT edge_id, count(*) FILTER (WHERE outcome <> 'error') AS times_challenged,
  count(*) FILTER (WHERE outcome = 'not_found') AS times_survived,
  max(challenged_at) FILTER (WHERE outcome <> 'error') AS last_challenged
FROM challenges GROUP BY edge_id""", "challenges"))
def edge_survival(t):
    return review.survival(t["challenges"])


@query("stale_support", duck(_SUPPORT + f"""
, n AS (SELECT edge_id, max(content_timestamp) AS newest FROM support JOIN signals USING (signal_id)
  WHERE supporting GROUP BY edge_id)
SELECT e.edge_id, n.newest AS newest_support FROM edges e LEFT JOIN n ON n.edge_id = e.edge_id
WHERE NOT e.deprecated AND current_weight_band IN ('strong', 'moderate')
  AND (n.newest IS NULL OR n.newest < {SQL_AS_OF} - interval '5' day)""",
    "edges", "events_log", "event_triggers", "signals"))
def stale_support(t):
    d = review.stale_support(
        t["edges"], _support(t).filter("supporting"), t["signals"], now=AS_OF, days=5
    )
    return d.select("edge_id", "newest_support")


