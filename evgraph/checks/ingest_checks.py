"""Queries on content quality, landed rows, series and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.checks.registry import AS_OF, SQL_AS_OF, query
from evgraph.checks.tables import duck
from evgraph.functions.text import content_hash
from evgraph.operators import quality
from evgraph.plans import calibrate, extract, health, market, signals
from evgraph.sources import landed, sinks


def sql_list(words) -> str:
    """DuckDB list literal."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# Rule columns of a payload in SQL: length, characters in links, first stock phrase.
RULES = f"""
, rules AS (SELECT p.*, sha256(content) AS content_hash, date_trunc('day', fetched_at) AS run,
  length(content) AS n,
  cast(coalesce(list_sum(list_transform(regexp_extract_all(content, 'https?://\\S+'),
    lambda u: length(u))), 0) AS bigint) AS links,
  list_filter({sql_list(vocab.STOCK_PHRASES)}, lambda w: contains(lower(content), w))[1] AS phrase
  FROM payloads p)
, fit AS (SELECT * FROM rules WHERE n >= 80 AND links / n <= 0.4 AND phrase IS NULL)
"""
# A row is known when an earlier run stored the content within seven days of this run's start.
CHECKED = RULES + """
, known AS (SELECT r.*, EXISTS (SELECT 1 FROM rules o WHERE o.source_id = r.source_id
    AND o.content_hash = r.content_hash AND o.run < r.run
    AND o.fetched_at > r.run - interval '7' day) AS known FROM rules r)
, checked AS (SELECT k.*, CASE
    WHEN n < 80 THEN concat('content too short (', n, ' chars < 80)')
    WHEN known OR EXISTS (SELECT 1 FROM known f WHERE f.source_id = k.source_id
      AND f.content_hash = k.content_hash AND f.run = k.run AND NOT f.known
      AND f.n >= 80 AND f.links / f.n <= 0.4 AND f.phrase IS NULL
      AND (f.fetched_at, f.payload_id) < (k.fetched_at, k.payload_id))
      THEN 'exact duplicate of already-ingested content'
    WHEN links / n > 0.4 THEN concat('link density too high (', links, '/', n, ')')
    WHEN phrase IS NOT NULL THEN concat('SEO/noise phrase detected: ''', phrase, '''')
    END AS rejected_reason FROM known k)
"""


def checked(t):
    """Payloads with quality flags, one run per day."""
    p = t["payloads"].withColumn("arrival", F.col("payload_id"))
    return quality.check_runs(
        p, run=F.to_date("fetched_at"), run_start=F.date_trunc("day", "fetched_at")
    )


@query("payload_quality", duck(CHECKED + """
SELECT payload_id, source_id, content_hash, rejected_reason IS NOT NULL AS rejected,
  rejected_reason FROM checked""", "payloads"))
def payload_quality(t):
    return checked(t).select("payload_id", "source_id", "content_hash", "rejected", "rejected_reason")


@query("payload_archive_counts", duck(CHECKED + """
SELECT source_id, strftime(content_timestamp, '%Y-%m') AS month, count(*) AS n_payloads
FROM checked WHERE rejected_reason IS NULL GROUP BY ALL""", "payloads"))
def payload_archive_counts(t):
    return sinks.archive_layout(checked(t))


@query("stored_per_source", duck(CHECKED + """
SELECT source_id, count(*) FILTER (WHERE rejected_reason IS NULL) AS n_stored
FROM checked GROUP BY source_id""", "payloads"))
def stored_per_source(t):
    return health.stored_per_source(checked(t))


@query("payload_lengths", duck(CHECKED + """
SELECT payload_id, source_id, fetched_at, cast(n AS int) AS content_length FROM checked
WHERE rejected_reason IS NULL ORDER BY fetched_at DESC, payload_id LIMIT 20""", "payloads"))
def payload_lengths(t):
    return landed.recent_payloads(checked(t), limit=20).select(
        "payload_id", "source_id", "fetched_at", "content_length"
    )


@query("payload_replay", duck(CHECKED + f"""
SELECT payload_id, source_id, content_timestamp FROM checked WHERE rejected_reason IS NULL
AND content_timestamp BETWEEN timestamp '2024-01-06' AND {SQL_AS_OF}""", "payloads"))
def payload_replay(t):
    return landed.replay(checked(t), AS_OF.replace(day=6), AS_OF).select(
        "payload_id", "source_id", "content_timestamp"
    )


_HEADER = """concat('Tue, ', lpad(cast(1 + page_id % 28 AS varchar(2)), 2, '0'), ' Jan 2024 ',
  lpad(cast(page_id % 24 AS varchar(2)), 2, '0'), ':00:00 GMT')"""


@query("page_rows", f"""
WITH p AS (SELECT *, {_HEADER} AS header, regexp_extract(html, 'lang="([^"]*)"', 1) AS lang FROM pages)
SELECT url, coalesce(nullif(lower(substring(trim(lang), 1, 2)), ''), 'en') AS language,
  strptime(regexp_replace(header, '^\\w+,\\s*', ''), '%d %b %Y %H:%M:%S GMT') AS content_timestamp,
  substring(sha256(html), 1, 16) AS content_hash, cast(length(html) AS int) AS n_chars
FROM p""")
def page_rows(t):
    p = t["pages"].select(
        "url", F.col("html").alias("body"), F.lit("web").alias("source_id"),
        F.lit("us_eu").alias("perspective"), F.lit(200).alias("status_code"),
        F.lit(AS_OF).alias("fetched_at"), F.lit(None).cast("string").alias("language"),
        F.regexp_extract("html", 'lang="([^"]*)"', 1).alias("content_language"),
        F.expr(_HEADER).alias("last_modified"), F.lit(None).cast("string").alias("date"),
    )
    return landed.page_rows(p).select(
        "url", "language", "content_timestamp", F.col("metadata")["content_hash"].alias("content_hash"),
        F.length("content").alias("n_chars"),
    )


# --- registry ------------------------------------------------------------------------

@query("registry_effective_weight", duck("""
SELECT s.source_id, s.starting_source_weight, o.weight AS override_weight,
  coalesce(o.weight, s.starting_source_weight) AS effective_weight,
  round(coalesce(o.weight, s.starting_source_weight) - s.starting_source_weight, 6) AS weight_delta
FROM sources s LEFT JOIN (SELECT * FROM overrides
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY applied_at DESC, override_id DESC) = 1) o
  ON o.source_id = s.source_id WHERE s.enabled""", "sources", "overrides"))
def registry_effective_weight(t):
    return calibrate.effective_weights(landed.enabled(t["sources"]), t["overrides"]).select(
        "source_id", "starting_source_weight", "override_weight", "effective_weight", "weight_delta"
    )


@query("override_scd2", duck("""
SELECT *, lead(applied_at) OVER (PARTITION BY source_id ORDER BY applied_at, override_id)
  AS superseded_at FROM overrides""", "overrides"))
def override_scd2(t):
    return calibrate.weight_versions(t["overrides"])


# --- series ---------------------------------------------------------------------------

_MOVE = """
, r AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k,
  count(*) OVER (PARTITION BY symbol) AS n FROM closes)
, m AS (SELECT a.symbol, a.close AS latest, b.close AS prior,
  (a.close - b.close) / b.close * 100 AS pct, b.k - 1 AS used_window
  FROM r a JOIN r b ON b.symbol = a.symbol AND b.k = least(6, a.n) WHERE a.k = 1 AND a.n >= 2)
"""


@query("move_by_count", duck(_MOVE + """
SELECT symbol, latest, prior, round(pct, 6) AS pct_change, used_window FROM m""", "closes"))
def move_by_count(t):
    return market.move_by_count(t["closes"], 5).withColumn("pct_change", F.round("pct_change", 6))


@query("move_sentence", duck(_MOVE + r"""
SELECT symbol, concat('Market move: ', symbol, ' (', symbol, ') ',
  CASE WHEN pct > 0 THEN 'rose' WHEN pct < 0 THEN 'fell' ELSE 'was flat' END, ' ',
  CASE WHEN pct > 0 THEN '+' ELSE '' END, printf('%.2f', pct), '% over the last ', used_window,
  ' trading days, ', regexp_replace(format('{:,.4f}', prior), '\.?0+$', ''), ' USD → ',
  regexp_replace(format('{:,.4f}', latest), '\.?0+$', ''), ' USD.') AS content FROM m""", "closes"))
def move_sentence(t):
    d = market.move_by_count(t["closes"], 5)
    return d.select("symbol", market.count_sentence(F.col("symbol"), F.lit("USD")).alias("content"))


@query("move_by_days", duck("""
, top AS (SELECT symbol, max(ts) AS lt, min(ts) AS ft, count(*) AS n FROM closes GROUP BY symbol)
, p AS (SELECT t.symbol, lt, n, coalesce((SELECT max(ts) FROM closes c WHERE c.symbol = t.symbol
  AND c.ts <= lt - interval '30' day), ft) AS pt FROM top t)
SELECT p.symbol, l.close AS latest, o.close AS prior, lt AS latest_ts, pt AS prior_ts,
  round((l.close - o.close) / o.close * 100, 6) AS pct_change
FROM p JOIN closes l ON l.symbol = p.symbol AND l.ts = lt
JOIN closes o ON o.symbol = p.symbol AND o.ts = pt WHERE n >= 2 AND o.close <> 0""", "closes"))
def move_by_days(t):
    d = market.move_by_days(t["closes"].withColumnRenamed("close", "value"), 30)
    return d.withColumn("pct_change", F.round("pct_change", 6))


@query("newest_per_series", duck("""
SELECT symbol AS series_id, ts, close AS value FROM closes
WHERE ts >= timestamp '1999-06-01' - interval '45' day
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 12""", "closes"))
def newest_per_series(t):
    obs = t["closes"].select(F.col("symbol").alias("series_id"), "ts", F.col("close").alias("value"))
    return landed.newest_per_series(obs, now=AS_OF.replace(year=1999, month=6, day=1))


_TAPE_CLASS = """CASE substring(symbol, 1, 1) WHEN '1' THEN 'commodity' WHEN '2' THEN 'bond_yield'
  WHEN '3' THEN 'currency' WHEN '4' THEN '' ELSE 'volatility' END"""


@query("market_tape", duck(f"""
, n AS (SELECT * FROM closes QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)
SELECT symbol, substring(symbol, 3) AS label, close / 1000 AS pct_change, close AS value,
  {_TAPE_CLASS} AS class, 'fred' AS source, ts AS as_of,
  CASE {_TAPE_CLASS} WHEN 'commodity' THEN 0 WHEN 'currency' THEN 1 WHEN 'equity_index' THEN 2
    WHEN 'volatility' THEN 3 WHEN 'bond_yield' THEN 4 ELSE 9 END AS class_order FROM n""", "closes"))
def market_tape(t):
    c = t["closes"]
    meta = {
        "symbol": F.col("symbol"), "label": F.substring("symbol", 3, 100),
        "pct_change": F.col("close") / 1000, "latest_value": F.col("close"),
        "instrument_class": F.expr(_TAPE_CLASS),
    }
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    return market.market_tape(c.select(
        F.lit("fred").alias("source_id"), F.lit(False).alias("rejected"),
        F.create_map(*pairs).alias("metadata"), F.col("ts").alias("content_timestamp"),
        F.concat("symbol", F.col("ts").cast("string")).alias("payload_id"),
    ))


# --- claims -----------------------------------------------------------------------------

_HASH = "substring(sha256(lower(regexp_replace(claim_text, '^\\s+|\\s+$', '', 'g'))), 1, 16)"


@query("signal_dedup", duck(f"""
SELECT signal_id, payload_id, lens_id FROM signals
QUALIFY row_number() OVER (PARTITION BY payload_id, {_HASH} ORDER BY signal_id) = 1""", "signals"))
def signal_dedup(t):
    return quality.dedup_claims(t["signals"], ["payload_id"], ["signal_id"]).select(
        "signal_id", "payload_id", "lens_id"
    )


@query("cross_lens", duck(f"""
SELECT {_HASH} AS claim_hash, count(*) AS n_signals, count(DISTINCT payload_id) AS n_payloads,
  count(DISTINCT lens_id) AS n_distinct, min(signal_id) AS first_signal
FROM signals GROUP BY 1 HAVING count(DISTINCT lens_id) > 1""", "signals"))
def cross_lens(t):
    return quality.convergence(t["signals"])


@query("cross_lens_signals", duck(f"""
, h AS (SELECT signal_id, lens_id, {_HASH} AS claim_hash FROM signals)
SELECT signal_id, claim_hash FROM h WHERE claim_hash IN (SELECT claim_hash FROM h
  GROUP BY claim_hash HAVING count(DISTINCT lens_id) > 1)""", "signals"))
def cross_lens_signals(t):
    return quality.convergent_signals(t["signals"]).select("signal_id", "claim_hash")


@query("cross_perspective", duck(f"""
SELECT {_HASH} AS claim_hash, count(*) AS n_signals, count(DISTINCT payload_id) AS n_payloads,
  count(DISTINCT perspective) AS n_distinct, min(signal_id) AS first_signal
FROM signals JOIN sources USING (source_id) GROUP BY 1
HAVING count(DISTINCT perspective) > 1""", "signals", "sources"))
def cross_perspective(t):
    d = t["signals"].join(t["sources"].select("source_id", "perspective"), "source_id")
    return quality.convergence(d, by="perspective")


@query("cluster_strength", duck(f"""
, j AS (SELECT {_HASH} AS cluster_id, perspective, starting_source_weight AS w,
  CASE confidence_band WHEN 'hard_datum' THEN 1.0 WHEN 'reported_claim' THEN 0.75
    WHEN 'inference' THEN 0.5 ELSE 0.25 END AS c
  FROM signals JOIN sources USING (source_id))
, g AS (SELECT cluster_id, count(*) AS n_signals, count(DISTINCT perspective) AS n_perspectives,
  cast(sum(cast(w AS decimal(10, 4))) AS double) / count(*) AS mw,
  cast(sum(cast(c AS decimal(10, 4))) AS double) / count(*) AS mc FROM j GROUP BY 1)
SELECT cluster_id, n_signals, n_perspectives,
  round((least(n_signals, 5) / 5 + least(n_perspectives, 3) / 3 + mw + mc) / 4, 6) AS strength
FROM g""", "signals", "sources"))
def cluster_strength(t):
    d = quality.claim_hash(F.col("claim_text"))
    out = signals.cluster_strength(t["signals"].withColumn("cluster_id", d), t["sources"])
    return out.select("cluster_id", "n_signals", "n_perspectives", F.round("strength", 6).alias("strength"))


_KIND = """CASE lens_id WHEN 'market' THEN 'spot_price' WHEN 'commodities' THEN 'inventory_level'
  WHEN 'regulatory' THEN 'policy_statement' ELSE 'other' END"""


@query("decayed_weight", duck(f"""
, k AS (SELECT signal_id, {_KIND} AS kind,
  epoch({SQL_AS_OF} - content_timestamp) / 86400 AS age FROM signals)
SELECT signal_id, round(CASE kind WHEN 'spot_price' THEN pow(0.5, age / 3)
  WHEN 'inventory_level' THEN pow(0.5, age / 90) WHEN 'policy_statement' THEN pow(0.5, age / 365)
  ELSE 1.0 END, 6) AS remaining_weight FROM k""", "signals"))
def decayed_weight(t):
    d = signals.decayed(t["signals"].withColumn("signal_kind", F.expr(_KIND)), now=AS_OF)
    return d.select("signal_id", F.round("remaining_weight", 6).alias("remaining_weight"))


@query("archive_split", duck(f"""
SELECT NOT anchored AND extracted_at < {SQL_AS_OF} - interval '10' day AS archived,
  count(*) AS n_signals, min(signal_id) AS first_signal, max(signal_id) AS last_signal
FROM signals GROUP BY 1""", "signals"))
def archive_split(t):
    hot, old = signals.archive_split(t["signals"], now=AS_OF, days=10)
    both = hot.withColumn("archived", F.lit(False)).unionAll(old.withColumn("archived", F.lit(True)))
    return both.groupBy("archived").agg(
        F.count(F.lit(1)).alias("n_signals"), F.min("signal_id").alias("first_signal"),
        F.max("signal_id").alias("last_signal"),
    )


@query("unanchored", duck(f"""
SELECT signal_id, lens_id, content_timestamp FROM signals
WHERE NOT anchored AND extracted_at < {SQL_AS_OF} - interval '1' hour
ORDER BY content_timestamp DESC, signal_id LIMIT 200""", "signals"))
def unanchored(t):
    return signals.unanchored(t["signals"], now=AS_OF, limit=200).select("signal_id", "lens_id", "content_timestamp")


@query("unanchored_all", duck(f"""
SELECT signal_id, lens_id, content_timestamp FROM signals
WHERE NOT anchored AND extracted_at < {SQL_AS_OF} - interval '1' hour""", "signals"))
def unanchored_all(t):
    return signals.unanchored(t["signals"], now=AS_OF).select("signal_id", "lens_id", "content_timestamp")


@query("recent_by_source", duck("""
SELECT signal_id, lens_id, extracted_at FROM signals WHERE payload_id IN
  (SELECT payload_id FROM payloads WHERE source_id = 'src3')
ORDER BY extracted_at DESC, signal_id LIMIT 50""", "signals", "payloads"))
def recent_by_source(t):
    d = signals.recent(t["signals"], t["payloads"], source_id="src3", limit=50)
    return d.select("signal_id", "lens_id", "extracted_at")


# --- responses -------------------------------------------------------------------------

_SCOPE = """CASE lens_id WHEN 'commodities' THEN ['entity', 'condition', 'event', 'quantity']
  WHEN 'market' THEN ['condition', 'quantity', 'entity'] ELSE ['claim'] END"""
_RESPONSES = f"""
, f AS (SELECT payload_id, lens_id, trim(CASE WHEN body LIKE '```%'
  THEN regexp_replace(body, '^```[^\\n]*\\n|\\n[^\\n]*$', '', 'g') ELSE body END) AS x FROM model_responses)
, a AS (SELECT payload_id, lens_id, CASE WHEN json_valid(x) THEN x
  ELSE nullif(regexp_extract(x, '(?s)\\[.*\\]', 0), '') END AS x FROM f)
, i AS (SELECT payload_id, lens_id, unnest(range(cast(json_array_length(x) AS bigint))) AS pos,
  unnest(json_extract(x, '$[*]')) AS item FROM a WHERE json_valid(x))
, s AS (SELECT payload_id, lens_id, pos, trim(coalesce(item ->> '$.claim_text', '')) AS claim_text,
  item ->> '$.confidence_band' AS band,
  len(list_filter(coalesce(json_extract(item, '$.proposed_anchors[*]'), []), lambda z:
    (z ->> '$.operation') <> 'create_node' OR list_contains({_SCOPE}, z ->> '$.node_type'))) AS n_anchors
  FROM i WHERE pos < CASE lens_id WHEN 'commodities' THEN 10 WHEN 'market' THEN 8 ELSE 6 END)
, valid AS (SELECT payload_id, lens_id, pos, claim_text,
  CASE WHEN band IN ('hard_datum', 'reported_claim', 'inference', 'weak_inference') THEN band
    ELSE 'weak_inference' END AS confidence_band, n_anchors
  FROM s WHERE claim_text <> '' AND length(claim_text) <= 500)
"""


@query("response_signals", duck(_RESPONSES + """
SELECT payload_id, lens_id, cast(pos AS int) AS pos, claim_text, confidence_band,
  cast(n_anchors AS int) AS n_anchors FROM valid""", "model_responses"))
def response_signals(t):
    d = extract.response_signals(t["model_responses"], vocab.lens_table(t.spark))
    return d.select("payload_id", "lens_id", "pos", "claim_text", "confidence_band",
                    F.size("proposed_anchors").alias("n_anchors"))


@query("no_signal_payloads", duck(_RESPONSES + f"""
SELECT payload_id, fetched_at FROM payloads
WHERE fetched_at > {SQL_AS_OF} - interval '240' hour
  AND length(content) >= 80 AND NOT EXISTS (SELECT 1 FROM valid v WHERE v.payload_id = payloads.payload_id)
ORDER BY fetched_at DESC, payload_id LIMIT 200""", "model_responses", "payloads"))
def no_signal_payloads(t):
    found = extract.response_signals(t["model_responses"], vocab.lens_table(t.spark))
    p = t["payloads"].withColumn("rejected", F.length("content") < vocab.MIN_CONTENT_CHARS)
    return landed.payloads_without_signals(p, found, now=AS_OF, hours=240, limit=200).select(
        "payload_id", "fetched_at"
    )


@query("no_signal_payloads_all", duck(_RESPONSES + f"""
SELECT payload_id, fetched_at FROM payloads
WHERE fetched_at > {SQL_AS_OF} - interval '240' hour
  AND length(content) >= 80 AND NOT EXISTS (SELECT 1 FROM valid v WHERE v.payload_id = payloads.payload_id)""",
    "model_responses", "payloads"))
def no_signal_payloads_all(t):
    found = extract.response_signals(t["model_responses"], vocab.lens_table(t.spark))
    p = t["payloads"].withColumn("rejected", F.length("content") < vocab.MIN_CONTENT_CHARS)
    return landed.payloads_without_signals(p, found, now=AS_OF, hours=240).select("payload_id", "fetched_at")


_OP_BODY = """concat('Proposed: [{"operation":"', operation, '","reasoning":"r"',
  coalesce(concat(',"proposed_id":"', proposed_id, '","fields":{"name":"', name, '"}'), ''),
  coalesce(concat(',"node_type":"', node_type, '"'), ''),
  coalesce(concat(',"source_node_id":"', source_ref, '","target_node_id":"', target_ref, '"'), ''),
  coalesce(concat(',"edge_type":"', edge_type, '","proposed_weight_band":"', weight_band, '"'), ''),
  coalesce(concat(',"falsification_criteria":"', falsification_criteria, '"'), ''),
  CASE WHEN pos = 7 THEN '}, 5] thanks' WHEN pos = 8 THEN '} thanks' ELSE '}]' END)"""


@query("response_operations", duck("""
, v AS (SELECT batch_id, pos, pos <> 8 AS parsed, CASE WHEN operation = 'create_node'
    THEN node_type IN ('entity', 'condition', 'event', 'quantity', 'scenario', 'claim')
    ELSE edge_type = 'causes' AND weight_band = 'weak' AND trim(falsification_criteria) <> '' END AS ok
  FROM operations)
SELECT batch_id * 100 + pos AS batch_id, parsed,
  cast(CASE WHEN parsed AND ok THEN 1 ELSE 0 END AS bigint) AS n_valid,
  cast(CASE WHEN parsed AND NOT ok THEN 1 ELSE 0 END + CASE WHEN pos = 7 THEN 1 ELSE 0 END AS bigint)
    AS n_skipped
FROM v""", "operations"))
def response_operations(t):
    d = t["operations"].selectExpr("batch_id * 100 + pos AS batch_id", f"{_OP_BODY} AS body")
    return extract.response_operations(d)[1]


# --- leakage and totals over tracked signals ---------------------------------------------

_SUSPECT = f"""
, c AS (SELECT signal_id, claim_text, reasoning, confidence_band, source_id, access_method,
  len(list_filter(regexp_extract_all(concat(reasoning, ' ', claim_text), '\\b(20\\d{{2}})\\b', 1),
    lambda y: cast(y AS int) > 2024)) > 0
  OR regexp_matches(reasoning, '(?i){"|".join(vocab.LEAK_PHRASES)}')
  OR (confidence_band = 'hard_datum' AND access_method = 'rss') AS bad
  FROM signals JOIN sources USING (source_id))
"""


@query("leakage_flags", duck(_SUSPECT + """
SELECT source_id, count(*) AS n, count(*) FILTER (WHERE bad) AS n_suspicious FROM c GROUP BY 1""",
    "signals", "sources"))
def leakage_flags(t):
    d = t["signals"].join(t["sources"].select("source_id", "access_method"), "source_id")
    return d.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(calibrate.suspicious(2024)).alias("n_suspicious")
    )


@query("leakage", duck(_SUSPECT + """
, n AS (SELECT least(count(*), greatest(20, least(200, cast(floor(count(*) * 0.02) AS bigint)))) AS k
  FROM c)
, smp AS (SELECT bad, row_number() OVER (ORDER BY sha256(concat(signal_id, '|42')), signal_id) AS r FROM c)
SELECT count(*) AS n_sampled, count(*) FILTER (WHERE bad) AS n_suspicious,
  round(count(*) FILTER (WHERE bad) / count(*), 6) AS leakage_rate,
  CASE WHEN count(*) FILTER (WHERE bad) / count(*) > 0.05 THEN 'Re-run recommended.'
    ELSE 'Within threshold.' END AS verdict
FROM smp, n WHERE r <= k""", "signals", "sources"))
def leakage(t):
    return calibrate.leakage(t["signals"].select("signal_id"), t["signals"], t["sources"], window_end=AS_OF)


@query("document_hashes", """
SELECT doc_id, sha256(text) AS content_hash FROM documents""")
def document_hashes(t):
    return t["documents"].select("doc_id", content_hash(F.col("text")).alias("content_hash"))
