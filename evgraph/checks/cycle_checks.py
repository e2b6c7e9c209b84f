"""Whole cycles and the smaller readers that feed them: context, extraction, challenge, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.checks.graph_checks import context_roots  # noqa: F401  (its SQL is built on below)
from evgraph.checks.ingest_checks import _RESPONSES
from evgraph.checks.landed_checks import scenario_responses
from evgraph.checks.registry import AS_OF, SQL, SQL_AS_OF, query
from evgraph.checks.stream_checks import home
from evgraph.checks.tables import duck
from evgraph.checks.view_checks import CAL_TABLES, OUTCOME, pending
from evgraph.operators import quality, vectors
from evgraph.plans import anchoring, calibrate, extract, market, review, scenarios
from evgraph.session import cut_lineage, stored
from evgraph.sources import landed

# --- context of a batch ------------------------------------------------------------------------

_REACH = """
, roots AS (SELECT f.batch_id, f.node_id FROM f JOIN h USING (batch_id, name_no) WHERE before < 6)
, ends AS (SELECT source_node_id AS a, target_node_id AS b, edge_id FROM edges WHERE NOT deprecated
  UNION ALL SELECT target_node_id, source_node_id, edge_id FROM edges WHERE NOT deprecated)
, reach AS (SELECT batch_id, node_id FROM roots UNION SELECT batch_id, b FROM roots JOIN ends ON a = node_id)
, near AS (SELECT DISTINCT batch_id, edge_id FROM reach JOIN ends ON a = node_id)
, n_n AS (SELECT batch_id, count(*) AS n FROM reach GROUP BY batch_id)
, n_e AS (SELECT batch_id, count(*) AS n FROM near GROUP BY batch_id)
, head AS (SELECT n_n.batch_id, length(concat('**Tier B subgraph** (', n_n.n, ' nodes, ', coalesce(n_e.n, 0), ' edges)',
  chr(10), chr(10), '### Nodes')) AS lead FROM n_n LEFT JOIN n_e USING (batch_id))
, nl AS (SELECT batch_id, node_id AS item, concat('- [', node_type, '] **', name, '** (id=', node_id, ')',
    CASE WHEN coalesce(description, '') <> '' THEN concat(' — ', left(description, 120)) ELSE '' END) AS line
  FROM reach JOIN condition_nodes USING (node_id))
, nr AS (SELECT nl.*, lead, length(line) + 1 AS size, sum(length(line) + 1) OVER (PARTITION BY batch_id ORDER BY item) AS run
  FROM nl JOIN head USING (batch_id))
, nk AS (SELECT batch_id, item, line, lead + run AS used FROM nr WHERE run = size OR lead + run - size <= 4800)
, cut AS (SELECT batch_id, max(used) + CASE WHEN max(used) > 4800 THEN length('  *(node list truncated)*') + 1 ELSE 0 END
    + length(concat(chr(10), '### Edges')) + 1 AS lead FROM nk GROUP BY batch_id)
, el AS (SELECT batch_id, edge_id AS item, concat('- ', source_node_id, ' --', edge_type, '--> ', target_node_id, ' [',
    current_weight_band, '] (id=', edge_id, ')', CASE WHEN coalesce(falsification_criteria, '') <> ''
    THEN concat(chr(10), '  *falsification*: ', left(falsification_criteria, 200)) ELSE '' END) AS line
  FROM near JOIN edges USING (edge_id))
, er AS (SELECT el.*, lead, length(line) + 1 AS size, sum(length(line) + 1) OVER (PARTITION BY batch_id ORDER BY item) AS run
  FROM el JOIN cut USING (batch_id))
SELECT batch_id, 'nodes' AS section, item, line, cast(used AS bigint) AS used FROM nk
UNION ALL SELECT batch_id, 'edges', item, line, cast(lead + run AS bigint) FROM er WHERE run = size OR lead + run - size <= 8000"""


@query("batch_context", duck("", "operations", "condition_nodes", "edges")
       + SQL["context_roots"][SQL["context_roots"].index(", names AS"):].rpartition("\nSELECT")[0] + _REACH)
def batch_context(t):
    """GRA-07 with GRA-03/04: the packed context of every batch at the budget of 8,000 characters."""
    names = t["operations"].filter("operation = 'create_node' AND trim(name) <> ''").select(
        "batch_id", F.col("pos").alias("name_no"), F.lower("name").alias("name"))
    return anchoring.batch_context(names, t["condition_nodes"], t["edges"]).select("batch_id", "section", "item", "line", "used")


@query("vector_clusters_strict", SQL["vector_clusters"].replace("> 0.35", "> 0.92"))
def vector_clusters_strict(t):
    """DES-01 at the threshold of the operator."""
    return vectors.cluster_vectors(t["claim_vectors"]).select("signal_id", "cluster_id")


# --- extraction --------------------------------------------------------------------------------

_CLAIM = "left(sha256(lower(claim_text)), 16)"


def _extracted(t):
    """The cycle over all responses against a store that has those of even payloads."""
    lenses = vocab.lens_table(t.spark)
    stored = extract.extract_signals(t["payloads"], t["model_responses"], lenses).filter("payload_id % 2 = 0")
    return extract.extraction_cycle(t["payloads"], t["model_responses"], lenses, stored, extracted_at=AS_OF)


@query("extraction_cycle", duck(_RESPONSES + f"""
SELECT payload_id, lens_id, cast(pos AS int) AS pos, claim_text, source_id, content_timestamp, {SQL_AS_OF} AS extracted_at
FROM valid JOIN payloads USING (payload_id) WHERE payload_id % 2 = 1
QUALIFY row_number() OVER (PARTITION BY payload_id, {_CLAIM} ORDER BY lens_id, pos) = 1""", "model_responses", "payloads"))
def extraction_cycle(t):
    """EXT-01/02: signals of all responses that are not stored yet, one per claim of a payload."""
    return _extracted(t)[0].select("payload_id", "lens_id", "pos", "claim_text", "source_id", "content_timestamp", "extracted_at")


@query("extraction_convergence", duck(_RESPONSES + f"""
SELECT {_CLAIM} AS claim_hash, count(*) AS n_signals, count(DISTINCT payload_id) AS n_payloads, count(DISTINCT lens_id) AS n_distinct
FROM valid GROUP BY 1 HAVING count(DISTINCT lens_id) > 1""", "model_responses"))
def extraction_convergence(t):
    """EXT-02: the report of claims that several lenses put forward."""
    return _extracted(t)[1].select("claim_hash", "n_signals", "n_payloads", "n_distinct")


_WORDS = sorted({w for ws in vocab.DIMENSION_KEYWORDS.values() for w in ws})
_HIT = "CASE " + " ".join(f"WHEN contains(lower(content), '{w}') THEN '{w.strip()}'" for w in _WORDS) + " END"


@query("scored_signals", duck(f"""
, hit AS (SELECT payload_id, trim(left(trim(string_split_regex(content, '[.\\n]+')[1]), 500)) AS claim_text, {_HIT} AS word FROM payloads)
, lens AS (SELECT unnest([{", ".join(f"'{x}'" for x in vocab.ACTIVE_LENSES)}]) AS lens_id)
SELECT cast(payload_id AS varchar) AS payload_id, lens_id, claim_text, concat('mentions ', word) AS reasoning
FROM hit, lens WHERE word IS NOT NULL AND claim_text <> ''""", "payloads"))
def scored_signals(t):
    """UDF-02: every payload scored under every lens in Arrow batches, and the answers parsed."""
    answers = cut_lineage(extract.score_payloads(t["payloads"], extract.keyword_scorer))
    return extract.response_signals(answers, vocab.lens_table(t.spark)).select("payload_id", "lens_id", "claim_text", "reasoning")


def _proposing(t):
    """Signals of each payload with the nodes they propose."""
    anchor = F.struct(F.lit("create_node").alias("operation"), "name")
    d = t["signal_entities"].groupBy("signal_id").agg(F.array_sort(F.collect_list(anchor)).alias("proposed_anchors"))
    return d.select("signal_id", F.floor(F.col("signal_id") / 1_000_000).alias("batch_id"),
                    (F.col("signal_id") % 1_000_000).alias("signal_no"), "proposed_anchors")


@query("signal_names", duck("""
SELECT DISTINCT signal_id, lower(trim(name)) AS name FROM signal_entities""", "signal_entities"))
def signal_names(t):
    """FLT-26."""
    return extract.entity_names(_proposing(t))


@query("batch_names", duck("""
, a AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY name) - 1 AS k FROM signal_entities)
SELECT signal_id // 1000000 AS batch_id, name, signal_id % 1000000 * 1000 + k AS name_no FROM a
QUALIFY row_number() OVER (PARTITION BY signal_id // 1000000, lower(name) ORDER BY signal_id, k) = 1""", "signal_entities"))
def batch_names(t):
    """FLT-27: names of each payload's signals in order of first mention."""
    return extract.batch_entity_names(_proposing(t))


# --- challenge pass ----------------------------------------------------------------------------

_DST = "cast(split_part(edge_id, '-', 2) AS int) % 5"
_ANSWER = """concat('{"outcome":"', OUT, '","reasoning":"why ', edge_id, '","operations":[{"operation":"update_edge_weight",
  "target_edge_id":"', edge_id, '","new_weight_band":"weak","direction":"weaken","reasoning":"r"}]}')"""
_PASS = SQL["challenge_candidates_all"].replace("\nSELECT edge_id,", "\n, due AS (SELECT edge_id,", 1) + ")"


def _passed(t):
    """A pass over all due edges: found, not found, no answer in the text, a failed call, no response."""
    body = f"""CASE {_DST} WHEN 0 THEN {_ANSWER.replace('OUT', "'found'")}
      WHEN 1 THEN concat('```json\\n', {_ANSWER.replace('OUT', "'not_found'")}, '\\n```') WHEN 2 THEN 'nothing' END"""
    edges, nodes = stored(t["edges"]), stored(t["condition_nodes"])  # read six times
    responses = edges.filter(f"{_DST} < 4").selectExpr("edge_id", f"{body} AS body", f"{_DST} = 3 AS failed")
    return review.run_pass(edges, nodes, t["signals"], responses, now=AS_OF)


@query("challenge_pass", _PASS + f"""
SELECT edge_id, CASE {_DST} WHEN 0 THEN 'found' WHEN 1 THEN 'not_found' ELSE 'error' END AS outcome,
  CASE {_DST} WHEN 2 THEN 'No JSON found in LLM output.' WHEN 3 THEN 'LLM call failed' WHEN 4 THEN 'LLM call failed'
    ELSE concat('why ', edge_id) END AS reasoning, current_weight_band AS weight_band_at_challenge, {SQL_AS_OF} AS challenged_at FROM due""")
def challenge_pass(t):
    """DSC-02: the log of a pass."""
    return _passed(t)["log"]


@query("challenge_stamps", _PASS + f"""
SELECT e.edge_id, CASE WHEN d.edge_id IS NOT NULL AND {_DST.replace('edge_id', 'e.edge_id')} < 3 THEN {SQL_AS_OF}
    ELSE last_disconfirmation_pass END AS last_disconfirmation_pass,
  CASE WHEN d.edge_id IS NOT NULL AND {_DST.replace('edge_id', 'e.edge_id')} = 0 THEN 'weak' ELSE e.current_weight_band END AS current_weight_band
FROM edges e LEFT JOIN due d ON d.edge_id = e.edge_id""")
def challenge_stamps(t):
    """SNK-13: all edges after a pass; those that were answered carry its time and new band."""
    return _passed(t)["edges"].select("edge_id", "last_disconfirmation_pass", "current_weight_band")


# --- calibration -------------------------------------------------------------------------------

@query("calibration_live", duck(OUTCOME.replace(f"tr.content_timestamp >= {SQL_AS_OF}", "tr.content_timestamp >= timestamp '2024-01-10 00:00:00'") + """
SELECT signal_id, outcome, cast(score AS double) AS score FROM sc""", *CAL_TABLES))
def calibration_live(t):
    """CAL-10: of the pending rows those that are ten days old are resolved."""
    return calibrate.checkpoint_live(pending(t), now=AS_OF, observation_days=10, **_tables(t)).select("signal_id", "outcome", "score")


def _tables(t):
    clustered = F.when(F.col("payload_id") % 3 == 0, F.col("payload_id").cast("string"))
    return {"signals": t["signals"].withColumn("cluster_id", clustered), "events": t["events_log"], "triggers": t["event_triggers"],
            "edges": t["edges"], "weight_history": t["edge_history"]}


_RUN = OUTCOME[:OUTCOME.index(", tr AS")] + """
, tr AS (SELECT signal_id, signals.source_id, lens_id, signals.content_timestamp FROM signals JOIN payloads USING (payload_id)
  WHERE length(content) >= 80 AND payloads.content_timestamp BETWEEN timestamp '2024-01-05' AND timestamp '2024-01-12')
""" + OUTCOME[OUTCOME.index(", o AS"):]


def _run(t):
    """A calibration run over a week of payloads."""
    tables = _tables(t)
    kept = tables.pop("signals")
    p = t["payloads"].withColumn("rejected", F.length("content") < vocab.MIN_CONTENT_CHARS)
    return calibrate.execute_run(
        p, lambda d: kept.join(d.select("payload_id"), "payload_id"), run_id="week", window_start=AS_OF.replace(day=5),
        window_end=AS_OF.replace(day=12), registry=t["sources"], **tables)


@query("calibration_run", duck(_RUN + """
SELECT signal_id, source_id, lens_id, outcome, cast(score AS double) AS score FROM sc""", *CAL_TABLES, "payloads"))
def calibration_run(t):
    """CAL-09: replayed, extracted, registered and resolved."""
    return _run(t)[0].select("signal_id", "source_id", "lens_id", "outcome", "score")


@query("calibration_report", duck(_RUN + """
, b AS (SELECT source_id, outcome, count(*) AS n FROM sc GROUP BY ALL)
SELECT source_id, count(*) AS n_signals, round(cast(sum(score) AS double) / count(*), 6) AS mean_score,
  (SELECT string_agg(outcome || '=' || n, '|' ORDER BY outcome) FROM b WHERE b.source_id = sc.source_id) AS breakdown,
  (SELECT count(*) FROM sc) AS n_total FROM sc GROUP BY source_id""", *CAL_TABLES, "payloads"))
def calibration_report(t):
    """CAL-07: the report of the run, read back from its JSON text."""
    kind = ("n_total long, sources array<struct<source_id string, n_signals long, mean_score double, "
            "breakdown map<string, long>>>")
    d = _run(t)[1].select(F.from_json("report", kind).alias("r")).select("r.n_total", F.inline("r.sources"))
    parts = F.transform(F.array_sort(F.map_keys("breakdown")), lambda k: F.concat(k, F.lit("="), F.element_at("breakdown", k)))
    return d.select("source_id", "n_signals", F.round("mean_score", 6).alias("mean_score"),
                    F.array_join(parts, "|").alias("breakdown"), "n_total")


# --- readers -----------------------------------------------------------------------------------

@query("scenario_list", f"""
WITH x AS ({SQL["scenario_store"]})
SELECT title, time_horizon FROM x WHERE dimension = 'economic_stability' AND NOT deprecated AND cast(substring(title, 7) AS bigint) <= 2880""")
def scenario_list(t):
    """FLT-29: scenarios of one dimension up to a moment that no later save replaced."""
    stored = scenarios.with_deprecation(extract.parse_scenarios(scenario_responses(t).drop("doc_id")))
    return scenarios.read_scenarios(stored, as_of=AS_OF.replace(day=AS_OF.day + 2), dimension="economic_stability").select("title", "time_horizon")


_SERIES = "CASE left(symbol, 1) WHEN '1' THEN 'DCOILWTICO' WHEN '2' THEN 'DEXUSEU' WHEN '3' THEN 'VIXCLS' WHEN '4' THEN 'SP500' ELSE symbol END"


@query("series_classes", duck(f"""
, s AS (SELECT {_SERIES} AS series_id FROM closes)
SELECT series_id, CASE series_id WHEN 'DCOILWTICO' THEN 'commodity' WHEN 'DEXUSEU' THEN 'currency' WHEN 'VIXCLS' THEN 'volatility'
    WHEN 'SP500' THEN 'equity_index' ELSE '' END AS instrument_class,
  CASE series_id {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.SERIES_LABELS.items())} ELSE series_id END AS label, count(*) AS n
FROM s GROUP BY series_id""", "closes"))
def series_classes(t):
    """SER-04: class and name of the series of all closes."""
    s = F.col("series_id")
    return t["closes"].selectExpr(f"{_SERIES} AS series_id").groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).select(
        "series_id", market.instrument_class(s).alias("instrument_class"), market.series_label(s).alias("label"), "n")


@query("normalised_payloads", duck("""
SELECT sha256(concat_ws('|', source_id, 'u' || payload_id, cast(fetched_at AS varchar), sha256(content))) AS payload_id,
  coalesce(CASE WHEN payload_id % 3 > 0 THEN content_timestamp END, fetched_at) AS content_timestamp, sha256(content) AS digest
FROM payloads""", "payloads"))
def normalised_payloads(t):
    """PRJ-01: ids from content, the digest in the metadata, missing times filled."""
    p = t["payloads"].withColumns({
        "url": F.concat(F.lit("u"), "payload_id"), "metadata": F.create_map(F.lit("content_hash"), F.lit("old")),
        "content_timestamp": F.when(F.col("payload_id") % 3 > 0, F.col("content_timestamp"))})
    return quality.normalise(p).select("payload_id", "content_timestamp", F.element_at("metadata", F.lit("content_hash")).alias("digest"))


@query("notable_events", """
SELECT event_id, ts AS occurred_at FROM events ORDER BY ts, concat(event_type, '-', event_id) LIMIT 2000""")
def notable_events(t):
    """SRC-18: the first events by time and label."""
    e = t["events"].select("event_id", F.col("ts").alias("occurred_at"), F.concat("event_type", F.lit("-"), "event_id").alias("label"))
    return landed.notable_events(e, 2000).select("event_id", "occurred_at")


@query("registry_rows", duck("""
SELECT source_id, concat('https://host.example/', source_id) AS url_base, CASE WHEN tier = '3' THEN '2' ELSE tier END AS tier,
  perspective, access_method, CASE WHEN tier = '1' THEN 0.5 ELSE starting_source_weight END AS weight, enabled FROM sources""", "sources"))
def registry_rows(t):
    """SRC-01: the registry stored as JSON lines and loaded with defaults and variables."""
    path = f"{home(t)}/registry"
    t["sources"].select(
        "source_id", F.concat(F.lit("https://${HOST}/"), "source_id").alias("url_base"), F.when(F.col("tier") != "3", F.col("tier")).alias("tier"),
        "perspective", "access_method", F.when(F.col("tier") != "1", F.col("starting_source_weight")).alias("starting_source_weight"), "enabled",
    ).write.json(path)
    return landed.load_registry(t.spark, path, {"HOST": "host.example"}).select(
        "source_id", "url_base", "tier", "perspective", "access_method", F.col("starting_source_weight").alias("weight"), "enabled")


@query("dispatched_rows", duck("""
SELECT source_id, content_type, count(*) AS n FROM (SELECT source_id, 'feed' AS content_type FROM payloads WHERE payload_id % 3 <> 0
  UNION ALL SELECT source_id, 'page' FROM payloads WHERE payload_id % 3 = 0) z
WHERE source_id IN (SELECT source_id FROM sources WHERE enabled) GROUP BY ALL""", "payloads", "sources"))
def dispatched_rows(t):
    """SRC-12: rows of two readers, of enabled sources only."""
    none = F.lit(None).cast("string")
    p = t["payloads"].withColumns({"url": none, "perspective": none, "metadata": F.create_map().cast("map<string,string>")})
    readers = {name: p.filter(which).withColumn("content_type", F.lit(name))
               for name, which in (("feed", "payload_id % 3 <> 0"), ("page", "payload_id % 3 = 0"))}
    return landed.dispatch(readers, t["sources"]).groupBy("source_id", "content_type").agg(F.count(F.lit(1)).alias("n"))
