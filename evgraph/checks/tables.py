"""Engine tables built from the given tables, as SQL that both Spark and DuckDB run.

``DERIVED`` holds one SELECT per engine table.  Every row of the given tables
takes part and texts are used whole.  Only the sentence split differs between
the dialects.  Spark reads them through :class:`Tables`; the check SQL prepends
them as common table expressions with :func:`duck`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from evgraph.session import configure

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_LENS = """CASE (doc_id + k) % 7 WHEN 0 THEN 'commodities' WHEN 1 THEN 'financial'
  WHEN 2 THEN 'geopolitical' WHEN 3 THEN 'market' WHEN 4 THEN 'physical_world'
  WHEN 5 THEN 'regulatory' ELSE 'narrative_divergence' END"""
_STATE = """CASE {c} WHEN 'purchase' THEN 'active' WHEN 'error' THEN 'inactive'
  WHEN 'view' THEN 'partially_active' WHEN 'click' THEN 'disputed' ELSE 'unknown' END"""
_BAND = """CASE {c} % 5 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' WHEN 2 THEN 'weak'
  WHEN 3 THEN 'provisional' ELSE 'disputed' END"""

DERIVED: dict[str, str] = {
    "sources": """
SELECT source AS source_id,
  CASE n % 4 WHEN 0 THEN 'structured_data' WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '3' END AS tier,
  CASE n % 6 WHEN 0 THEN 'us_eu' WHEN 1 THEN 'india' WHEN 2 THEN 'china' WHEN 3 THEN 'russia'
    WHEN 4 THEN 'gulf' ELSE 'southeast_asia_pacific' END AS perspective,
  CASE n % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'api' ELSE 'http' END AS access_method,
  cast(50 + 2 * n AS double) / 100 AS starting_source_weight,
  n % 10 <> 9 AS enabled
FROM (SELECT DISTINCT source, cast(substring(source, 4) AS int) n FROM documents) t""",
    # One weight proposal per source and label value pair; sources without labels have none.
    "overrides": """
SELECT min(d.doc_id) AS override_id, d.source AS source_id,
  cast(30 + 40 * l.quality + 5 * l.toxic AS double) / 100 AS weight,
  timestamp '2024-01-05 00:00:00' + l.quality * interval '7' day
    + l.toxic * interval '1' day AS applied_at
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
GROUP BY d.source, l.quality, l.toxic""",
    "payloads": """
SELECT doc_id AS payload_id, source AS source_id, text AS content, lang AS language,
  timestamp '2024-01-01 00:00:00' + (doc_id % 28) * interval '1' day AS content_timestamp,
  timestamp '2024-01-01 06:00:00' + (doc_id % 28) * interval '1' day
    + (doc_id % 24) * interval '1' hour AS fetched_at
FROM documents""",
    "signals": f"""
SELECT doc_id * 1000000 + k AS signal_id, doc_id AS payload_id, source AS source_id,
  {_LENS} AS lens_id, claim AS claim_text,
  CASE doc_id % 5 WHEN 0 THEN concat('seen in ', cast(2015 + doc_id % 15 AS varchar(4)))
    WHEN 1 THEN concat('Q3 ', cast(2015 + doc_id % 15 AS varchar(4)), ' data')
    WHEN 2 THEN 'prices have since recovered' ELSE 'steady supply' END AS reasoning,
  CASE (doc_id + k) % 4 WHEN 0 THEN 'hard_datum' WHEN 1 THEN 'reported_claim'
    WHEN 2 THEN 'inference' ELSE 'weak_inference' END AS confidence_band,
  timestamp '2024-01-01 00:00:00' + (doc_id % 28) * interval '1' day AS content_timestamp,
  timestamp '2024-01-01 07:00:00' + (doc_id % 28) * interval '1' day
    + (doc_id % 24) * interval '1' hour AS extracted_at,
  doc_id % 11 = 0 AS anchored
FROM sentences""",
    # The first name comes from the document's number, the second (every fifth) chains it on.
    "signal_entities": """
SELECT doc_id * 1000000 + k AS signal_id, concat('Entity ', cast(doc_id % 200 AS varchar(10))) AS name
FROM sentences
UNION ALL
SELECT doc_id * 1000000 + k, concat(' entity ', cast((doc_id + 1) % 200 AS varchar(10)))
FROM sentences WHERE doc_id % 5 = 0""",
    "condition_nodes": f"""
SELECT concat('u', cast(user_id AS varchar(20))) AS node_id, 'condition' AS node_type,
  concat(CASE user_id % 7 WHEN 0 THEN 'bank credit stress' WHEN 1 THEN 'military border conflict'
    WHEN 2 THEN 'oil export supply' WHEN 3 THEN 'flood and drought' WHEN 4 THEN 'policy reform'
    WHEN 5 THEN 'plain item' ELSE 'market and oil price' END, ' ',
    cast(user_id AS varchar(20))) AS name,
  CASE WHEN user_id % 3 = 0 THEN 'sanction risk' ELSE NULL END AS description,
  {_STATE.format(c='last_type')} AS current_state, c AS created_at, u AS updated_at
FROM (SELECT user_id, min(ts) c, max(ts) u, max_by(event_type, event_id) last_type
      FROM events GROUP BY user_id) t""",
    "condition_history": f"""
SELECT event_id AS id, concat('u', cast(user_id AS varchar(20))) AS node_id,
  {_STATE.format(c='event_type')} AS new_state, ts AS content_timestamp
FROM events""",
    "steps": """
SELECT e.event_id, e.ts, e.event_type, e.user_id AS dst, p.user_id AS src
FROM events e JOIN events p ON p.event_id = e.event_id - 1
WHERE p.user_id <> e.user_id""",
    "edge_history": f"""
SELECT event_id AS id, concat('c', cast(src AS varchar(20)), '-', cast(dst AS varchar(20))) AS edge_id,
  {_BAND.format(c='event_id')} AS weight_band,
  CASE event_type WHEN 'purchase' THEN 'strengthened' WHEN 'error' THEN 'weakened'
    WHEN 'signup' THEN 'disconfirmation' ELSE 'initial' END AS change_type,
  ts AS content_timestamp
FROM steps""",
    "edges": f"""
SELECT concat('c', cast(src AS varchar(20)), '-', cast(dst AS varchar(20))) AS edge_id,
  concat('u', cast(src AS varchar(20))) AS source_node_id,
  concat('u', cast(dst AS varchar(20))) AS target_node_id,
  CASE (src + dst) % 9 WHEN 0 THEN 'causes' WHEN 1 THEN 'enables' WHEN 2 THEN 'constrains'
    WHEN 3 THEN 'accelerates' WHEN 4 THEN 'correlates_with' WHEN 5 THEN 'contradicts'
    WHEN 6 THEN 'refines' WHEN 7 THEN 'part_of' ELSE 'produces' END AS edge_type,
  {_BAND.format(c='last_id')} AS current_weight_band,
  CASE WHEN (src * 7 + dst) % 10 = 0 THEN '' ELSE 'flow returns to baseline' END
    AS falsification_criteria,
  CASE WHEN last_id % 3 = 0 THEN NULL ELSE timestamp '2024-01-01 00:00:00'
    + (last_id % 28) * interval '1' day END AS last_disconfirmation_pass,
  (src + 3 * dst) % 25 = 0 AS deprecated, c AS created_at, u AS updated_at
FROM (SELECT src, dst, min(ts) c, max(ts) u, max(event_id) last_id FROM steps
      GROUP BY src, dst) t""",
    "large_edges": """
SELECT s * 1000000 + p AS edge_id, concat('s', cast(s AS varchar(20))) AS source_node_id,
  concat('p', cast(p AS varchar(20))) AS target_node_id, false AS deprecated
FROM (SELECT DISTINCT l_suppkey s, l_partkey p FROM lineitem) t""",
    "supply_edges": f"""
SELECT s * 1000000 + p AS edge_id, concat('s', cast(s AS varchar(20))) AS source_node_id,
  concat('p', cast(p AS varchar(20))) AS target_node_id,
  concat('supplier ', cast(s AS varchar(20))) AS source_name,
  concat(p_name, ' ', lower(p_brand)) AS target_name,
  {_BAND.format(c='(s + p)')} AS current_weight_band, false AS deprecated,
  c AS created_at, u AS updated_at
FROM (SELECT l_suppkey s, l_partkey p, min(l_shipdate) c, max(l_shipdate) u FROM lineitem
      GROUP BY l_suppkey, l_partkey) t JOIN part ON p_partkey = p""",
    "topics": """
SELECT concat('t', cast(r_regionkey * 2 AS varchar(10))) AS topic_id, concat(r_name, ' north') AS name
FROM region
UNION ALL
SELECT concat('t', cast(r_regionkey * 2 + 1 AS varchar(10))), concat(r_name, ' south') FROM region
UNION ALL
SELECT concat('empty', cast(r_regionkey AS varchar(10))), concat(r_name, ' empty') FROM region""",
    "topic_nodes": """
SELECT concat('t', cast(user_id % 10 AS varchar(10))) AS topic_id,
  concat('u', cast(user_id AS varchar(20))) AS node_id
FROM (SELECT DISTINCT user_id FROM events) t
UNION
SELECT concat('t', cast((user_id + 1) % 10 AS varchar(10))), concat('u', cast(user_id AS varchar(20)))
FROM events WHERE event_type = 'signup'""",
    "events_log": """
SELECT event_id, cast(floor(event_id / 50) AS bigint) AS batch_id,
  concat('c', cast(src AS varchar(20)), '-', cast(dst AS varchar(20))) AS target_edge_id,
  event_id % 20 = 0 AS rejected, ts AS content_timestamp, ts + interval '1' hour AS applied_at
FROM steps""",
    # Some signal numbers do not exist on purpose.
    "event_triggers": """
SELECT event_id, cast(floor(event_id / 9) AS bigint) * 1000000 + (event_id * 7) % 20 AS signal_id
FROM events
UNION ALL
SELECT event_id, cast(floor(event_id / 9) AS bigint) * 1000000 + (event_id * 7 + 13) % 20 FROM events""",
    "challenges": """
SELECT event_id AS pass_event_id,
  concat('c', cast(src AS varchar(20)), '-', cast(dst AS varchar(20))) AS edge_id,
  CASE event_id % 4 WHEN 0 THEN 'not_found' WHEN 2 THEN 'found' ELSE 'error' END AS outcome,
  ts AS challenged_at
FROM steps""",
    "closes": """
SELECT o_orderpriority AS symbol, o_orderdate AS ts, max(o_totalprice) AS close
FROM orders GROUP BY o_orderpriority, o_orderdate""",
    "points": """
SELECT c_custkey AS point_id, cast((c_custkey * 37) % 181 - 90 AS double) AS lat,
  cast((c_custkey * 91) % 361 - 180 AS double) AS lon
FROM customer""",
    "name_nodes": """
SELECT concat('p', cast(p_partkey AS varchar(20))) AS node_id,
  concat(p_name, ' ', lower(p_brand)) AS name, lower(p_type) AS description
FROM part""",
    "questions": """
SELECT p_partkey AS question_id, concat('why is ', p_name, ' short') AS question FROM part""",
    # Parts with the moment they first shipped, and what each shipment did to part and delivery.
    "part_nodes": """
SELECT concat('p', cast(p_partkey AS varchar(20))) AS node_id,
  CASE WHEN p_partkey % 3 = 0 THEN 'condition' ELSE 'entity' END AS node_type,
  concat(p_name, ' ', lower(p_brand)) AS name,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE lower(p_type) END AS description,
  'unknown' AS current_state, c AS created_at,
  CASE WHEN p_partkey % 21 = 0 THEN NULL ELSE lower(p_type) END AS dimension
FROM part JOIN (SELECT l_partkey, min(l_shipdate) c FROM lineitem GROUP BY l_partkey) t ON p_partkey = l_partkey""",
    "part_history": """
SELECT id, concat('p', cast(p AS varchar(20))) AS node_id,
  CASE WHEN id % 2 = 0 THEN 'active' ELSE 'inactive' END AS new_state, ts AS content_timestamp
FROM (SELECT l_partkey p, l_shipdate ts, cast(sum(l_orderkey * 8 + l_linenumber) AS bigint) id FROM lineitem
      WHERE l_returnflag <> 'N' GROUP BY l_partkey, l_shipdate) t""",
    "delivery_history": f"""
SELECT id, s * 1000000 + p AS edge_id, {_BAND.format(c='id')} AS weight_band, ts AS content_timestamp
FROM (SELECT l_suppkey s, l_partkey p, l_shipdate ts, cast(sum(l_orderkey * 8 + l_linenumber) AS bigint) id FROM lineitem
      WHERE l_returnflag <> 'N' GROUP BY l_suppkey, l_partkey, l_shipdate) t""",
    "shipment_signals": """
SELECT s * 1000000 + p AS signal_id,
  concat('supplier ', cast(s AS varchar(20)), ' ships ', p_name, ' ', lower(p_brand)) AS claim_text,
  ts AS content_timestamp
FROM (SELECT l_suppkey s, l_partkey p, max(l_shipdate) ts FROM lineitem GROUP BY l_suppkey, l_partkey) t
JOIN part ON p_partkey = p""",
    "messages": """
SELECT conv_id AS session_id, turn AS message_no, role, text AS content,
  timestamp '2024-01-01 00:00:00' + conv_id * interval '1' hour + turn * interval '1' minute
    AS created_at
FROM conversations""",
    "operations": """
SELECT cast(floor(c_custkey / 20) AS bigint) AS batch_id, c_custkey % 20 AS pos,
  CASE WHEN c_custkey % 2 = 0 THEN 'create_node' ELSE 'create_edge' END AS operation,
  CASE WHEN c_custkey % 2 = 0 THEN concat('N', cast(c_custkey AS varchar(20))) END AS proposed_id,
  CASE WHEN c_custkey % 2 = 1 THEN NULL WHEN c_custkey % 22 = 0 THEN 'galaxy'
    WHEN c_custkey % 34 = 0 THEN 'condition' ELSE 'entity' END AS node_type,
  CASE WHEN c_custkey % 2 = 1 THEN NULL WHEN c_custkey % 26 = 0 THEN '  '
    ELSE concat('Entity ', cast(c_custkey % 90 AS varchar(20))) END AS name,
  CASE WHEN c_custkey % 2 = 1 OR c_custkey % 38 = 0 THEN NULL ELSE 'place' END AS entity_kind,
  CASE WHEN c_custkey % 2 = 1 THEN concat('n', cast(c_custkey - 1 AS varchar(20))) END AS source_ref,
  CASE WHEN c_custkey % 2 = 0 THEN NULL
    WHEN c_custkey % 15 = 0 THEN concat('n', cast(c_custkey - 1 AS varchar(20)))
    WHEN c_custkey % 21 = 0 THEN 'missing_slug'
    ELSE concat('n', cast(c_custkey - 3 AS varchar(20))) END AS target_ref,
  CASE WHEN c_custkey % 2 = 0 THEN NULL WHEN c_custkey % 33 = 0 THEN 'influences'
    ELSE 'causes' END AS edge_type,
  CASE WHEN c_custkey % 2 = 0 THEN NULL WHEN c_custkey % 39 = 0 THEN 'huge' ELSE 'weak' END
    AS weight_band,
  CASE WHEN c_custkey % 2 = 0 THEN NULL WHEN c_custkey % 35 = 0 THEN ' '
    ELSE 'returns to baseline' END AS falsification_criteria,
  timestamp '2024-01-01 00:00:00' + cast(floor(c_custkey / 20) AS bigint) * interval '1' hour
    AS content_timestamp
FROM customer""",
    "weight_operations": """
SELECT event_id AS op_id, cast(floor(event_id / 50) AS bigint) AS batch_id, event_id % 50 AS pos,
  CASE event_id % 3 WHEN 0 THEN 'update_edge_weight' WHEN 1 THEN 'add_supporting_signal'
    ELSE 'add_disconfirming_signal' END AS operation,
  CASE WHEN event_id % 41 = 0 THEN 'no-such-edge'
    ELSE concat('c', cast(src AS varchar(20)), '-', cast(dst AS varchar(20))) END AS target_edge_id,
  CASE event_id % 7 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' WHEN 2 THEN 'weak'
    WHEN 3 THEN 'provisional' WHEN 4 THEN 'disputed' WHEN 5 THEN 'strong' ELSE 'vast' END
    AS new_weight_band,
  CASE WHEN event_id % 2 = 0 THEN 'strengthen' ELSE 'weaken' END AS direction,
  event_id * 10 AS signal_id, ts AS content_timestamp
FROM steps""",
    "model_responses": """
SELECT doc_id AS payload_id,
  CASE doc_id % 3 WHEN 0 THEN 'commodities' WHEN 1 THEN 'market' ELSE 'narrative_divergence' END
    AS lens_id,
  CASE doc_id % 4
    WHEN 0 THEN concat('[{"claim_text":" claim ', cast(doc_id AS varchar(20)),
      '","confidence_band":"inference","proposed_anchors":[{"operation":"create_node",',
      '"node_type":"entity"},{"operation":"create_node","node_type":"claim"},',
      '{"operation":"update_node"}]}]')
    WHEN 1 THEN concat('```json', chr(10), '[{"claim_text":"claim ', cast(doc_id AS varchar(20)),
      '","confidence_band":"certain"},{"claim_text":"  "},{"claim_text":"two"},',
      '{"claim_text":"three"},{"claim_text":"four"},{"claim_text":"five"},{"claim_text":"six"},',
      '{"claim_text":"seven"},{"claim_text":"eight"},{"claim_text":"nine"}]', chr(10), '```')
    WHEN 2 THEN concat('Here: [{"claim_text":"claim ', cast(doc_id AS varchar(20)), '"}] end')
    ELSE 'not json' END AS body
FROM documents""",
    "claim_vectors": """
SELECT vec_id AS signal_id, embedding AS vector, label AS lens_no FROM embeddings""",
    "costs": """
SELECT event_id AS call_id, ts, cast(value AS decimal(18, 2)) AS cost_usd, user_id AS key_id
FROM events""",
}

_SPARK_ONLY = {
    "sentences": r"""
SELECT doc_id, source, k, claim FROM documents
LATERAL VIEW posexplode(split(text, '[.\n]+')) s AS k, claim WHERE length(trim(claim)) > 0""",
}
_DUCK_ONLY = {
    "sentences": r"""
SELECT * FROM (SELECT doc_id, source, unnest(range(len(parts))) AS k, unnest(parts) AS claim
  FROM (SELECT doc_id, source, string_split_regex(text, '[.\n]+') AS parts FROM documents) d) u
WHERE length(trim(claim)) > 0""",
}


def _closure(names: list[str], texts: dict[str, str]) -> list[str]:
    """Tables needed by ``names`` in dependency order."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out or name not in texts:
            return
        for word in re.findall(r"\b[a-z_]+\b", texts[name]):
            if word != name and word in texts:
                visit(word)
        out.append(name)

    for n in names:
        visit(n)
    return out


def _with(names: list[str], texts: dict[str, str]) -> str:
    needed = _closure(names, texts)
    return ",\n".join(f"{n} AS ({texts[n].strip()})" for n in needed)


_SPARK_TEXTS = {**DERIVED, **_SPARK_ONLY}
_DUCK_TEXTS = {**DERIVED, **_DUCK_ONLY}


def duck(body: str, *names: str, recursive: bool = False) -> str:
    """Check SQL: the named engine tables as CTEs in front of ``body``.

    ``body`` may start with further CTEs, written ``, name AS (...)``.
    """
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + _with(list(names), _DUCK_TEXTS) + "\n" + body.strip()


class Tables:
    """Engine tables of one data folder as DataFrames, read lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")
        self._seen: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        """A given table; timestamps without zone become UTC timestamps."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        for field in df.schema.fields:
            if field.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(field.name, df[field.name].cast("timestamp"))
        return df

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in BASE:
                self._seen[name] = self.base(name)
            else:
                text = _SPARK_TEXTS[name]
                words = set(re.findall(r"\b[a-z_]+\b", text))
                inputs = {w: self[w] for w in words if w != name and (w in BASE or w in _SPARK_TEXTS)}
                sql = re.sub(
                    r"\b(FROM|JOIN) (\w+)",
                    lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in inputs else m[0],
                    text.replace("{", "{{").replace("}", "}}"),
                )
                used = set(re.findall(r"(?<!\{)\{(\w+)\}", sql))
                self._seen[name] = self.spark.sql(sql, **{k: inputs[k] for k in used})
        return self._seen[name]
