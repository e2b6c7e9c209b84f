"""Landed model responses to signals and operations (FLT-13..18, FLT-21, EXT, UDF-02)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.functions.text import strip, words
from evgraph.operators.mutate import valid_slug
from evgraph.operators.ordered import join_summary
from evgraph.operators.quality import convergence, dedup_claims
from evgraph.session import cut_lineage

ANCHOR_TYPE = "struct<operation:string,node_type:string,edge_type:string,name:string,body:string>"


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def is_object(v: Column) -> Column:
    """True for a JSON object."""
    return F.schema_of_variant(v).startswith("OBJECT")


def _elements(v: Column) -> Column:
    """Elements of a parsed JSON array; null for anything else."""
    return _get(v, "$", "array<variant>")


def with_response_items(responses: DataFrame) -> DataFrame:
    """FLT-13: ``items``, the elements of a signal response.

    A leading code fence loses its first and last line.  Text that is not valid
    JSON is cut from the first ``[`` to the last ``]``; anything else gives none.
    Each text is parsed once, a second time only when it is not valid as a whole.
    """
    text = strip(F.col("body"))
    fenced = strip(F.regexp_replace(text, r"(?s)^```[^\n]*\n?(.*?)\n?[^\n]*$", "$1"))
    d = responses.withColumn("__text", F.when(text.startswith("```"), fenced).otherwise(text))
    d = d.withColumn("__whole", F.try_parse_json("__text"))
    inner = F.regexp_extract("__text", r"(?s)\[.*\]", 0)
    d = d.withColumn(
        "__json", F.coalesce("__whole", F.when(F.col("__whole").isNull(), F.try_parse_json(inner)))
    )
    return d.withColumn("items", _elements(F.col("__json"))).drop("__text", "__whole", "__json", "body")


def with_operation_items(responses: DataFrame) -> DataFrame:
    """FLT-18: ``items``, the elements of an operation list: fenced anywhere, whole, or embedded."""
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    text = strip(F.col("body"))
    d = responses.withColumn(
        "__text", F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(text)
    )
    d = d.withColumn("__list", _elements(F.try_parse_json("__text")))
    inner = F.try_parse_json(F.regexp_extract("__text", r"(?s)\[.*\]", 0))
    d = d.withColumn(
        "items", F.coalesce("__list", F.when(F.col("__list").isNull(), _elements(inner)))
    )
    return d.drop("__text", "__list", "body")


def _anchors(v: Column) -> Column:
    """First ten anchors of a signal, non-objects removed, as typed structs with the raw text."""
    raw = F.coalesce(_get(v, "$.proposed_anchors", "array<variant>"), F.array().cast("array<variant>"))
    typed = F.transform(
        F.slice(raw, 1, vocab.MAX_ANCHORS),
        lambda a: F.struct(
            _get(a, "$.operation", "string").alias("operation"),
            _get(a, "$.node_type", "string").alias("node_type"),
            _get(a, "$.edge_type", "string").alias("edge_type"),
            _get(a, "$.fields.name", "string").alias("name"),
            F.to_json(a).alias("body"),
        ),
    )
    return F.filter(typed, lambda a: a["body"].startswith("{"))


def in_scope(anchors: Column, node_scope: Column, edge_scope: Column) -> Column:
    """FLT-15: drop creations of types outside the lens scope; everything else passes."""
    def allowed(a: Column) -> Column:
        node_ok = F.coalesce(F.array_contains(node_scope, a["node_type"]), F.lit(False))
        edge_ok = F.coalesce(F.array_contains(edge_scope, a["edge_type"]), F.lit(False))
        return (
            F.when(a["operation"] == "create_node", node_ok)
            .when(a["operation"] == "create_edge", edge_ok)
            .otherwise(True)
        )

    return F.filter(anchors, allowed)


def response_signals(responses: DataFrame, lenses: DataFrame) -> DataFrame:
    """FLT-13..16: validated signals of landed responses.

    ``responses`` holds payload_id, lens_id and body.  The cap of the lens applies
    before validation.  The catalogue is a fixed table of a few lenses.
    """
    d = responses.join(F.broadcast(lenses), "lens_id")
    d = with_response_items(d).select(
        "payload_id", "lens_id", "max_signals", "node_scope", "edge_scope",
        # Without ``outer`` the optimizer filters by the size of the list first, and parses each text again for that.
        F.posexplode_outer("items").alias("pos", "item"),
    )
    # An element that is not an object has no claim and drops out below.
    d = d.filter(F.col("pos") < F.col("max_signals"))
    claim = strip(F.coalesce(_get(F.col("item"), "$.claim_text", "string"), F.lit("")))
    band = _get(F.col("item"), "$.confidence_band", "string")
    known = F.coalesce(band.isin(vocab.CONFIDENCE_BANDS), F.lit(False))
    reasoning = F.coalesce(_get(F.col("item"), "$.reasoning", "string"), F.lit(""))
    d = d.select(
        F.sha2(F.concat_ws("|", F.col("payload_id").cast("string"), "lens_id",
                           F.col("pos").cast("string")), 256).alias("signal_id"),
        "payload_id", "lens_id", "pos", claim.alias("claim_text"),
        F.when(known, band).otherwise("weak_inference").alias("confidence_band"),
        F.substring(reasoning, 1, vocab.MAX_REASONING_CHARS).alias("reasoning"),
        in_scope(_anchors(F.col("item")), F.col("node_scope"), F.col("edge_scope"))
        .alias("proposed_anchors"),
    )
    return d.filter((F.col("claim_text") != "") & (F.length("claim_text") <= vocab.MAX_CLAIM_CHARS))


def entity_names(signals: DataFrame) -> DataFrame:
    """FLT-26: (signal_id, name) of the nodes a signal proposes, stripped and lower-case."""
    names = F.transform(
        F.filter("proposed_anchors", lambda a: (a["operation"] == "create_node")
                 & (F.coalesce(a["name"], F.lit("")) != "")),
        lambda a: F.lower(strip(a["name"])),
    )
    return signals.select("signal_id", F.explode(F.array_distinct(names)).alias("name"))


def batch_entity_names(signals: DataFrame) -> DataFrame:
    """FLT-27: distinct names per batch in order of first mention, first spelling kept.

    ``signals`` holds batch_id, signal_no and proposed_anchors; batches are small.
    """
    d = signals.select(
        "batch_id", "signal_no", F.posexplode("proposed_anchors").alias("anchor_no", "a")
    ).filter("a.operation = 'create_node' AND coalesce(a.name, '') <> ''")
    first = F.struct("signal_no", "anchor_no", F.col("a.name").alias("name"))
    return d.groupBy("batch_id", F.lower("a.name").alias("key")).agg(F.min(first).alias("f")).select(
        "batch_id", F.col("f.name").alias("name"),
        (F.col("f.signal_no") * 1000 + F.col("f.anchor_no")).alias("name_no"),
    )


def typed_operations(items: DataFrame, item: str = "item") -> DataFrame:
    """FLT-18/22: operation columns and ``valid`` for each JSON element."""
    v = F.col(item)
    text = lambda p: _get(v, p, "string")
    d = items.select(
        *[c for c in items.columns if c != item],
        text("$.operation").alias("operation"), F.lower(text("$.proposed_id")).alias("proposed_id"),
        text("$.node_type").alias("node_type"), _get(v, "$.fields", "map<string,string>").alias("fields"),
        _get(v, "$.fields.aliases", "array<string>").alias("aliases"),
        text("$.target_node_id").alias("target_node_id"),
        _get(v, "$.field_updates", "map<string,string>").alias("field_updates"),
        text("$.source_node_id").alias("source_ref"), text("$.edge_type").alias("edge_type"),
        text("$.proposed_weight_band").alias("weight_band"),
        text("$.falsification_criteria").alias("falsification_criteria"),
        text("$.target_edge_id").alias("target_edge_id"),
        text("$.new_weight_band").alias("new_weight_band"), text("$.direction").alias("direction"),
        text("$.signal_id").alias("signal_id"), text("$.reasoning").alias("reasoning"),
    ).withColumn("target_ref", F.col("target_node_id"))
    has = lambda c: F.col(c).isNotNull()
    why = has("reasoning")
    target = has("target_edge_id")
    valid = (
        F.when(F.col("operation") == "create_node",
               F.col("node_type").isin(vocab.NODE_TYPES) & valid_slug(F.col("proposed_id"))
               & has("fields") & why)
        .when(F.col("operation") == "update_node", has("target_node_id") & has("field_updates") & why)
        .when(F.col("operation") == "create_edge",
              has("source_ref") & has("target_ref") & F.col("edge_type").isin(vocab.EDGE_TYPES)
              & F.col("weight_band").isin(vocab.WEIGHT_BANDS) & why
              & (strip(F.col("falsification_criteria")) != ""))
        .when(F.col("operation") == "update_edge_weight",
              target & F.col("new_weight_band").isin(vocab.WEIGHT_BANDS)
              & F.col("direction").isin("strengthen", "weaken") & why)
        .when(F.col("operation").isin("add_supporting_signal", "add_disconfirming_signal"),
              target & has("signal_id"))
    )
    return d.withColumn("valid", F.coalesce(valid, F.lit(False)))


def response_operations(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-18: valid operations of landed batch responses, and counts per batch.

    ``responses`` holds batch_id and body.  ``n_skipped`` counts invalid elements;
    ``parsed`` is false when no JSON array was found.
    """
    # Few bytes of landed rows lie in few files, and parsing takes long, so the rows are dealt over all tasks.
    n = int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = with_operation_items(responses.repartition(n))
    # Without ``outer`` the optimizer filters by the size of the list first, and parses each text again for that.
    flat = typed_operations(d.select("batch_id", F.col("items").isNotNull().alias("parsed"), F.posexplode_outer("items").alias("pos", "item")))
    rows = flat.filter("pos IS NOT NULL").drop("parsed")
    narrow = cut_lineage(flat.select("batch_id", "parsed", "pos", "valid"))
    element = F.col("pos").isNotNull()
    sums = narrow.groupBy("batch_id").agg(
        F.count_if(element & F.col("valid")).alias("n_valid"), F.count_if(element & ~F.col("valid")).alias("n_skipped"), F.count(F.lit(1)).alias("n"))
    # One row per response, whether or not its list has elements.
    heads = narrow.filter("pos IS NULL OR pos = 0").select("batch_id", "parsed")
    counts = join_summary(heads, sums, ["batch_id"], "n").fillna(0, ["n_valid", "n_skipped"])
    return rows.filter("valid").drop("valid"), counts


def parse_scenarios(responses: DataFrame) -> DataFrame:
    """FLT-21: scenario rows of landed responses (dimension, body, as_of, generated_at, model_used)."""
    # --- fixed values: scenario bands and default horizon ---
    bands, horizon = ["high", "moderate", "low", "negligible"], "3–6 months"
    text = strip(F.regexp_replace(strip(F.col("body")), r"(?m)^```[a-zA-Z]*\s*", ""))
    text = strip(F.regexp_replace(text, r"(?m)\s*```$", ""))
    keep = [c for c in responses.columns if c != "body"]
    d = responses.select(*keep, F.posexplode(_elements(F.try_parse_json(text))).alias("pos", "item"))
    d = d.filter(is_object(F.col("item")))
    field = lambda p: strip(F.coalesce(_get(F.col("item"), p, "string"), F.lit("")))
    band = F.lower(field("$.probability_band"))
    given = _get(F.col("item"), "$.time_horizon", "string")
    d = d.select(
        F.sha2(F.concat_ws("|", F.coalesce("dimension", F.lit("")), F.col("generated_at").cast("string"),
                           F.col("pos").cast("string")), 256).alias("scenario_id"),
        *keep, field("$.title").alias("title"), field("$.summary").alias("summary"),
        F.when(band.isin(bands), band).otherwise("moderate").alias("probability_band"),
        F.when(given.isNull(), F.lit(horizon)).otherwise(strip(given)).alias("time_horizon"),
    )
    return d.filter("title <> '' AND summary <> ''")


# --- cycles --------------------------------------------------------------------------

Scorer = Callable[[Iterator], Iterator]


def score_payloads(
    payloads: DataFrame, scorer: Scorer, lens_ids: list[str] = vocab.ACTIVE_LENSES
) -> DataFrame:
    """UDF-02: responses of a model called per payload and lens, in Arrow batches.

    ``scorer`` maps pandas batches of (payload_id, source_id, lens_id, content) to
    batches of (payload_id, lens_id, body).
    """
    asked = payloads.select(
        F.col("payload_id").cast("string").alias("payload_id"), "source_id",
        F.explode(words(lens_ids)).alias("lens_id"), "content",
    )
    return asked.mapInPandas(scorer, "payload_id string, lens_id string, body string")


def keyword_scorer(batches: Iterator) -> Iterator:
    """Deterministic stand-in for a model: the first sentence when the text names a keyword.

    The rows of a payload, one per lens, follow each other; each text of a batch is read once.
    """
    import json

    import pandas as pd

    known = sorted({w for ws in vocab.DIMENSION_KEYWORDS.values() for w in ws})
    for pdf in batches:
        which, texts = pd.factorize(pdf["content"].fillna(""))
        texts = pd.Series(texts, dtype=object)
        hit = texts.str.lower().map(lambda t: next((w for w in known if w in t), None))
        claim = texts.str.split(r"[.\n]+", n=1, regex=True).str[0].str.strip()
        bodies = [
            json.dumps([{"claim_text": c[:500], "confidence_band": "weak_inference",
                         "reasoning": f"mentions {w.strip()}"}]) if w else "[]"
            for c, w in zip(claim, hit)
        ]
        out = pdf[["payload_id", "lens_id"]].copy()
        out["body"] = [bodies[i] for i in which]
        yield out


def extract_signals(payloads: DataFrame, responses: DataFrame, lenses: DataFrame) -> DataFrame:
    """EXT-01: signals of all lenses for each payload; a missing response adds nothing."""
    signals = response_signals(responses, lenses)
    return signals.join(
        payloads.select("payload_id", "source_id", "content_timestamp"), "payload_id"
    )


def extraction_cycle(
    payloads: DataFrame,
    responses: DataFrame,
    lenses: DataFrame,
    stored: DataFrame | None,
    *,
    extracted_at,
    challenge_edges: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """EXT-02: new signals to append and the cross-lens convergence report.

    Responses of the challenge lens count only when there are edges to challenge.
    """
    if challenge_edges is None or challenge_edges.isEmpty():
        responses = responses.filter(F.col("lens_id") != vocab.CHALLENGE_LENS)
    signals = extract_signals(payloads, responses, lenses).withColumn(
        "extracted_at", F.lit(extracted_at)
    )
    found = convergence(signals)
    signals = dedup_claims(signals, ["payload_id"], ["lens_id", "pos"])
    if stored is not None:
        signals = signals.join(stored.select("signal_id"), "signal_id", "left_anti")
    return signals, found


