"""Queries that write through the sinks and whole cycles, and read back what they left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.checks.graph_checks import graph_events
from evgraph.checks.ingest_checks import CHECKED, checked
from evgraph.checks.landed_checks import scenario_responses
from evgraph.checks.registry import AS_OF, SQL, SQL_AS_OF, query
from evgraph.checks.stream_checks import home
from evgraph.checks.tables import duck
from evgraph.checks.view_checks import CAL_TABLES, OUTCOME, histories, resolved
from evgraph.operators import asof
from evgraph.plans import calibrate, changes, dimensions, scenarios, sessions
from evgraph.plans.home import home_view
from evgraph.plans.ingest import run_all
from evgraph.session import cut_lineage
from evgraph.sources import sinks


def in_runs(d: DataFrame, write, path: str) -> None:
    """Two runs, the first of them twice and with other rows at first, as after a failure."""
    even, odd = d.filter("payload_id % 2 = 0"), d.filter("payload_id % 2 = 1")
    write(d.filter("payload_id % 3 = 0"), path, run="a")
    write(even, path, run="a")
    write(odd, path, run="b")


@query("payload_store", duck(CHECKED + """
SELECT source_id, strftime(content_timestamp, '%Y-%m') AS month, CASE payload_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS run,
  count(*) AS n, count(*) FILTER (WHERE rejected_reason IS NULL) AS n_accepted, min(payload_id) AS first_id,
  cast(sum(length(content)) AS bigint) AS n_chars
FROM checked GROUP BY ALL""", "payloads"))
def payload_store(t):
    """SNK-01 read back: every payload once, in the run that wrote it last."""
    path = f"{home(t)}/payloads"
    in_runs(cut_lineage(checked(t)), sinks.write_payloads, path)
    return t.spark.read.parquet(path).groupBy("source_id", "month", "run").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("rejected")).alias("n_accepted"), F.min("payload_id").alias("first_id"),
        F.sum(F.length("content")).alias("n_chars"))


@query("payload_archive", duck(CHECKED + """
SELECT payload_id, source_id, strftime(content_timestamp, '%Y-%m') AS month, sha256(content) AS digest
FROM checked WHERE rejected_reason IS NULL""", "payloads"))
def payload_archive(t):
    """SNK-02 read back: accepted payloads with whole texts from the JSON archive."""
    path = f"{home(t)}/archive"
    d = cut_lineage(checked(t))
    in_runs(d, sinks.archive_payloads, path)
    fields = "payload_id long, content string, source_id string, month string"
    back = t.spark.read.schema(fields).json(path)
    return back.select("payload_id", "source_id", "month", F.sha2("content", 256).alias("digest"))


@query("new_signals", duck("""
SELECT DISTINCT source_id, lens_id, claim_text FROM signals s WHERE NOT EXISTS (SELECT 1 FROM signals o
  WHERE o.payload_id % 2 = 0 AND o.source_id = s.source_id AND o.lens_id = s.lens_id AND o.claim_text = s.claim_text)""", "signals"))
def new_signals(t):
    """SNK-03: of all signals those whose key is not stored yet, one per key."""
    s = t["signals"]
    keys = ["source_id", "lens_id", "claim_text"]
    return sinks.only_new(s, s.filter("payload_id % 2 = 0"), keys).select(*keys)


@query("event_log", SQL["apply_events"].rpartition("\nSELECT")[0] + """
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE rejection_reason IS NOT NULL) AS n_rejected FROM ev GROUP BY event_type""")
def event_log(t):
    """SNK-06 read back: events by month folder, written twice under one run."""
    path = f"{home(t)}/log"
    events = cut_lineage(graph_events(t))
    for _ in range(2):
        sinks.append_events(events, path, run="a")
    return t.spark.read.parquet(path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("rejected").alias("n_rejected"))


@query("ingest_cycle", duck(CHECKED.replace("date_trunc('day', fetched_at) AS run", f"{SQL_AS_OF} AS run") + """
SELECT source_id, count(*) FILTER (WHERE rejected_reason IS NULL) AS n_stored FROM checked GROUP BY source_id""", "payloads"))
def ingest_cycle(t):
    """ING-01 as one run over all payloads: flagged, stored, archived and counted."""
    at = home(t)
    p = t["payloads"].withColumns({
        "arrival": F.col("payload_id"), "url": F.col("payload_id").cast("string"), "metadata": F.create_map().cast("map<string,string>")})
    return run_all(p, None, now=AS_OF, store=f"{at}/store", archive=f"{at}/archive")


@query("session_spans", duck("""
SELECT session_id, count(*) AS n_messages, min(created_at) AS started_at, max(created_at) AS last_active
FROM messages GROUP BY session_id""", "messages"))
def session_spans(t):
    """WIN-09."""
    return sessions.sessions(t["messages"])


@query("outcome_counts", duck(OUTCOME + """
SELECT signal_id, source_id, outcome, count(*) OVER (PARTITION BY source_id, outcome) AS cnt FROM sc""", *CAL_TABLES))
def outcome_counts(t):
    """WIN-01."""
    return calibrate.outcome_counts(resolved(t)).select("signal_id", "source_id", "outcome", "cnt")


@query("override_newest", duck("""
SELECT *, lead(applied_at) OVER (PARTITION BY source_id ORDER BY applied_at, override_id) AS superseded_at FROM overrides
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY applied_at DESC, override_id DESC) <= 20""", "overrides"))
def override_newest(t):
    """WIN-10."""
    return calibrate.override_history(t["overrides"])


@query("applied_weights", SQL["source_scores"].rpartition("SELECT source_id")[0] + f"""
SELECT sha256('run|' || source_id) AS override_id, source_id, proposed_weight AS weight, 'run' AS calibration_run_id,
  {SQL_AS_OF} AS applied_at FROM p""")
def applied_weights(t):
    """CAL-08."""
    return calibrate.apply_weights(calibrate.source_scores(resolved(t), t["sources"]), "run", now=AS_OF)


@query("nodes_by_key", duck(f"""
SELECT node_id, name FROM condition_nodes WHERE created_at <= {SQL_AS_OF}
AND node_id IN (SELECT source_node_id FROM edges WHERE deprecated)""", "condition_nodes", "edges"))
def nodes_by_key(t):
    """FLT-09."""
    keys = t["edges"].filter("deprecated").select(F.col("source_node_id").alias("node_id"))
    return asof.nodes_by_key(t["condition_nodes"], keys, AS_OF).select("node_id", "name")


@query("edges_by_key", duck("""
SELECT edge_id, current_weight_band FROM edges WHERE NOT deprecated
AND edge_id IN (SELECT edge_id FROM edge_history WHERE change_type = 'weakened')""", "edges", "edge_history"))
def edges_by_key(t):
    """FLT-11."""
    keys = t["edge_history"].filter("change_type = 'weakened'").select("edge_id").distinct()
    return asof.edges_by_key(t["edges"], t["edge_history"], keys).select("edge_id", "current_weight_band")


@query("event_track", """
SELECT event_id, round((epoch_us(ts) - epoch_us(timestamp '2024-01-10')) / (epoch_us(timestamp '2024-01-20') - epoch_us(timestamp '2024-01-10')), 9)
  AS position FROM events WHERE ts BETWEEN timestamp '2024-01-10' AND timestamp '2024-01-20'""")
def event_track(t):
    """WIN-12."""
    e = t["events"].withColumn("occurred_at", F.col("ts"))
    d = dimensions.track_position(e, AS_OF.replace(day=10), AS_OF)
    return d.select("event_id", F.round("position", 9).alias("position"))


@query("projection_cycle", SQL["scenario_store"] + "\nWHERE doc_id % 4 <> 0")
def projection_cycle(t):
    """PRO-01: responses of all dimensions against a store that holds every fourth; rows that are new, with what is deprecated."""
    responses = scenario_responses(t)
    held = scenarios.parse_scenarios(responses.filter("doc_id % 4 = 0").drop("doc_id"))
    new = scenarios.projection_cycle(responses.drop("doc_id", "save_no", "replaces"), held, save_no=1)
    flagged = scenarios.with_deprecation(scenarios.parse_scenarios(responses.drop("doc_id")))
    return flagged.join(new.select("scenario_id"), "scenario_id", "left_semi").select(
        "title", "dimension", "probability_band", "time_horizon", "deprecated")


_NOTES = """
, held AS (SELECT dimension, 'old note' AS note, CASE dimension WHEN 'resource_availability' THEN basis_hash ELSE 'x' END AS h FROM basis)
SELECT b.dimension, CASE WHEN b.basis_hash = h THEN 'unchanged' WHEN n_changes = 0 THEN 'cleared' ELSE 'regenerate' END AS status,
  CASE WHEN b.basis_hash = h THEN note WHEN n_changes = 0 THEN '' ELSE concat('note on ', b.dimension) END AS note,
  CASE WHEN b.basis_hash = h THEN h ELSE b.basis_hash END AS basis_hash
FROM basis b JOIN held USING (dimension)"""


def _as_cte(sql: str, name: str) -> str:
    """SQL with its last SELECT as one more CTE."""
    head, _, tail = sql.rpartition("\nSELECT d.dimension")
    return f"{head}\n, {name} AS (SELECT d.dimension{tail})"


@query("note_refresh", _as_cte(SQL["change_basis_all"], "basis") + _NOTES)
def note_refresh(t):
    """SNK-10: one cached note is still right, the others are written anew or cleared."""
    w, s = histories(t)
    basis = cut_lineage(changes.change_basis(changes.change_stream(t["condition_nodes"], t["edges"], w, s, as_of=AS_OF)))
    same = F.col("dimension") == "resource_availability"
    cached = basis.select("dimension", F.lit("old note").alias("note"), F.when(same, F.col("basis_hash")).otherwise("x").alias("basis_hash"),
                          F.lit(AS_OF).alias("generated_at"))
    updates = changes.note_updates(basis, cached)
    written = basis.select("dimension", F.concat(F.lit("note on "), "dimension").alias("note"))
    after = changes.apply_notes(updates, cached, written, AS_OF)
    return after.join(updates.select("dimension", "status"), "dimension").select("dimension", "status", "note", "basis_hash")


@query("home_changes", SQL["recent_changes"].replace("LIMIT 50", "").replace("LIMIT 30", "").replace("LIMIT 15", "LIMIT 12"))
def home_changes(t):
    """CHG-05: the change list of the home view."""
    _, listed = _home(t)
    return listed.withColumn("topic_ids", F.array_join("topic_ids", "|"))


@query("home_scores", SQL["dimension_scores"].replace(
    "SELECT * EXCLUDE (delta) FROM score", "SELECT * EXCLUDE (delta), concat('note on ', dimension) AS note FROM score"))
def home_scores(t):
    """CHG-05: the dimensions of the home view with their notes."""
    return _home(t)[0]


def _home(t):
    w, s = histories(t)
    notes = t["condition_nodes"].select(F.explode(F.array(*[F.lit(d) for d in dimensions.vocab.DIMENSIONS])).alias("dimension")).distinct()
    notes = notes.withColumn("note", F.concat(F.lit("note on "), "dimension"))
    return home_view(t["condition_nodes"], t["edges"], w, s, t["topic_nodes"], notes, now=AS_OF)
