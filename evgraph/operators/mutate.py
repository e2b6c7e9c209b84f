"""Graph mutation as validate-and-resolve plus a fold of the event log (MUT).

A batch of proposed operations becomes one event per operation, applied or
rejected with a reason; current nodes, edges and histories are folds of the
events.  All batches are handled in one pass: what an operation sees depends on
earlier operations only through "the first creation per alias wins", which is an
aggregate, so no batch loop is needed.

Order of operations: (batch_time, batch_id as text, phase, pos).  Phases are create
nodes, update nodes, create edges, update weights, add supporting, add
disconfirming.  Time comes from the batch and never from the clock.

Every rejection, alias rewrite and empty update is logged as an event.
References ignore letter case.  An entity name met twice resolves to its first
creation, also inside one batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.functions.text import strip
from evgraph.operators.ordered import previous_value
from evgraph.session import cut_lineage, literal_table

# --- fixed values: rejection reasons and operation order -----------------------
REJECTIONS = {
    "node_type": "unknown node_type",
    "edge_type": "unknown edge_type",
    "band": "unknown weight_band",
    "falsification": "falsification_criteria is required on create_edge",
    "falsification_empty": "falsification_criteria must not be empty",
    "source": "source_node_id could not be resolved",
    "target": "target_node_id could not be resolved",
    "edge": "target_edge_id could not be resolved",
    "self_loop": "source_node_id and target_node_id are the same",
    "name": "create_node requires a non-empty name in fields",
    "entity_kind": "Entity node requires entity_kind in fields",
    "occurred_at": "Event node requires occurred_at in fields",
    "event_kind": "Event node requires event_kind in fields",
    "unit": "Quantity node requires unit in fields",
    "claim_text": "Claim node requires claim_text in fields",
    "claim_kind": "Claim node requires claim_kind in fields",
    "deprecated": "target edge is deprecated",
}
PHASES = {
    "create_node": 0,
    "update_node": 1,
    "create_edge": 2,
    "update_edge_weight": 3,
    "add_supporting_signal": 4,
    "add_disconfirming_signal": 5,
}
UUID_PATTERN = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"

OPERATION_SCHEMA = (
    "batch_id string, batch_time timestamp, pos long, operation string, proposed_id string, "
    "node_type string, fields map<string,string>, aliases array<string>, target_node_id string, "
    "field_updates map<string,string>, source_ref string, target_ref string, edge_type string, "
    "weight_band string, falsification_criteria string, target_edge_id string, "
    "new_weight_band string, direction string, signal_id string, reasoning string, "
    "source string, triggered_by array<string>"
)
NODE_SCHEMA = (
    "node_id string, node_type string, name string, description string, "
    "type_data map<string,string>, created_at timestamp, updated_at timestamp"
)
EDGE_SCHEMA = (
    "edge_id string, source_node_id string, target_node_id string, edge_type string, "
    "current_weight_band string, falsification_criteria string, deprecated boolean, "
    "created_at timestamp, updated_at timestamp"
)
ALIAS_SCHEMA = "alias_text string, canonical_name string, canonical_node_id string"

_ORDER = ["batch_time", "batch_id", "phase", "pos"]


@dataclass
class Graph:
    """Current state a batch is applied to."""

    nodes: DataFrame
    edges: DataFrame
    aliases: DataFrame


def empty_graph(spark) -> Graph:
    """A graph without nodes."""
    return Graph(
        literal_table(spark, [], NODE_SCHEMA),
        literal_table(spark, [], EDGE_SCHEMA),
        literal_table(spark, [], ALIAS_SCHEMA),
    )


def complete(operations: DataFrame) -> DataFrame:
    """Add missing optional columns, the phase and the event id of each operation."""
    out = operations
    for f in literal_table(operations.sparkSession, [], OPERATION_SCHEMA).schema.fields:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    out = out.withColumn("batch_id", F.col("batch_id").cast("string"))
    phase = F.lit(None).cast("int")
    for name, n in PHASES.items():
        phase = F.when(F.col("operation") == name, F.lit(n)).otherwise(phase)
    return out.withColumn("phase", phase).withColumn(
        "event_id",
        F.sha2(F.concat_ws("|", F.lit("event"), F.col("batch_id"), "operation", "pos"), 256),
    )


# --- row rules -----------------------------------------------------------------

def _blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def valid_slug(c: Column) -> Column:
    """FLT-22: letters and digits with ``_`` and ``-``, at least one of the former."""
    return c.rlike(r"^[\p{L}\p{N}_-]+$") & c.rlike(r"[\p{L}\p{N}]")


def missing_field(node_type: Column, fields: Column) -> Column:
    """FLT-23: reason when a field the node type needs is missing or empty."""

    def lacks(key: str) -> Column:
        v = F.try_element_at(fields, F.lit(key))
        return v.isNull() | (v == "")

    claim_text = F.try_element_at(fields, F.lit("claim_text"))
    r = REJECTIONS
    return (
        F.when((node_type == "entity") & lacks("entity_kind"), r["entity_kind"])
        .when((node_type == "event") & lacks("occurred_at"), r["occurred_at"])
        .when((node_type == "event") & lacks("event_kind"), r["event_kind"])
        .when((node_type == "quantity") & lacks("unit"), r["unit"])
        .when((node_type == "claim") & _blank(claim_text), r["claim_text"])
        .when((node_type == "claim") & lacks("claim_kind"), r["claim_kind"])
    )


def type_data(fields: Column) -> Column:
    """FLT-24: the fields kept in the type payload."""
    return F.map_filter(fields, lambda k, v: ~k.isin("name", "description"))


# --- create nodes ----------------------------------------------------------------

def resolve_creations(creates: DataFrame, aliases: DataFrame) -> DataFrame:
    """MUT-02: decide for each valid entity creation whether it makes a node.

    ``creates`` holds op_key (orderable struct), event_id, alias_key, aliases;
    ``aliases`` the alias table.  Returns alias_key, node_id, made_by.

    Only the first creation per name can make a node.  It does unless an earlier
    made node claimed the name as one of its aliases.  Names that nobody claims
    are settled at once; chains of claims take one round per link.
    """
    first = creates.groupBy("alias_key").agg(
        F.min_by(F.struct("op_key", "event_id", "aliases"), "op_key").alias("c")
    ).select("alias_key", "c.op_key", "c.event_id", "c.aliases")
    committed = (
        aliases.filter(F.col("canonical_node_id").isNotNull())
        .groupBy(F.lower("alias_text").alias("alias_key"))
        .agg(F.min("canonical_node_id").alias("node_id"))
    )
    known = first.join(committed, "alias_key").select(
        "alias_key", "node_id", F.lit(None).cast("string").alias("made_by")
    )
    fresh = first.join(committed.select("alias_key"), "alias_key", "left_anti")
    waiting = aliases.filter(F.col("canonical_node_id").isNull()).select(
        F.lower("alias_text").alias("claimed"), F.lower("canonical_name").alias("alias_key")
    )
    claims = (
        fresh.select("alias_key", "op_key", F.explode("aliases").alias("a"))
        .select("alias_key", "op_key", F.lower(strip(F.col("a"))).alias("claimed"))
        .unionAll(
            fresh.join(waiting, "alias_key").select("alias_key", "op_key", "claimed")
        )
    )
    rivals = cut_lineage(
        claims.alias("c")
        .join(fresh.alias("f"), F.col("c.claimed") == F.col("f.alias_key"))
        .filter(
            (F.col("c.op_key") < F.col("f.op_key")) & (F.col("c.alias_key") != F.col("f.alias_key"))
        )
        .select(
            F.col("f.alias_key").alias("alias_key"),
            F.col("c.alias_key").alias("rival"),
            F.col("c.op_key").alias("rival_key"),
        )
        .distinct()
    )
    # owner null = makes its own node; otherwise the name whose node it becomes.
    settled = fresh.join(rivals.select("alias_key").distinct(), "alias_key", "left_anti").select(
        "alias_key", F.lit(None).cast("string").alias("owner")
    )
    open_keys = rivals.select("alias_key").distinct()
    while not open_keys.isEmpty():
        judged = rivals.join(open_keys, "alias_key", "left_semi").join(
            settled.select(
                F.col("alias_key").alias("rival"), F.lit(True).alias("done"),
                F.col("owner").isNull().alias("made"),
            ),
            "rival",
            "left",
        )
        ready = judged.groupBy("alias_key").agg(
            F.bool_and(F.coalesce("done", F.lit(False))).alias("ready"),
            F.min(F.when(F.col("made"), F.struct("rival_key", "rival"))).alias("winner"),
        ).filter("ready")
        settled = cut_lineage(
            settled.unionAll(ready.select("alias_key", F.col("winner.rival").alias("owner")))
        )
        open_keys = cut_lineage(
            open_keys.join(settled.select("alias_key"), "alias_key", "left_anti")
        )
    made = fresh.join(settled, "alias_key")
    own = made.filter(F.col("owner").isNull()).select(
        "alias_key", _node_id(F.col("event_id")).alias("node_id"), F.col("event_id").alias("made_by")
    )
    borrowed = (
        made.filter(F.col("owner").isNotNull())
        .select("alias_key", "owner")
        .join(own.select(F.col("alias_key").alias("owner"), "node_id"), "owner")
        .select("alias_key", "node_id", F.lit(None).cast("string").alias("made_by"))
    )
    return known.unionAll(own).unionAll(borrowed)


def _node_id(event_id: Column) -> Column:
    return F.sha2(F.concat(F.lit("node|"), event_id), 256)


def _create_nodes(ops: DataFrame, aliases: DataFrame) -> DataFrame:
    d = ops.filter("operation = 'create_node'").withColumn(
        "name", strip(F.try_element_at("fields", F.lit("name")))
    )
    reason = (
        F.when(~F.coalesce(F.col("node_type").isin(vocab.NODE_TYPES), F.lit(False)),
               REJECTIONS["node_type"])
        .when(_blank(F.col("name")), REJECTIONS["name"])
        .otherwise(missing_field(F.col("node_type"), F.col("fields")))
    )
    d = d.withColumn("rejection_reason", reason)
    entity = (F.col("node_type") == "entity") & F.col("rejection_reason").isNull()
    d = d.withColumn("alias_key", F.when(entity, F.lower("name")))
    found = resolve_creations(
        d.filter(F.col("alias_key").isNotNull()).select(
            "alias_key", "event_id", "aliases",
            F.struct("batch_time", "batch_id", "pos").alias("op_key"),
        ),
        aliases,
    )
    d = d.join(found.withColumnRenamed("node_id", "alias_node"), "alias_key", "left")
    aliased = F.col("alias_node").isNotNull() & ~F.col("made_by").eqNullSafe(F.col("event_id"))
    node_id = F.when(F.col("rejection_reason").isNotNull(), None).otherwise(
        F.coalesce("alias_node", _node_id(F.col("event_id")))
    )
    return d.withColumn("target_node", node_id).withColumn(
        "event_type", F.when(aliased, "create_node_aliased").otherwise(F.lit("create_node"))
    ).drop("alias_key", "alias_node", "made_by", "name")


# --- references --------------------------------------------------------------------

def resolve_refs(
    ops: DataFrame, ref: str, out: str, slugs: DataFrame, known: DataFrame, id_pattern: str
) -> DataFrame:
    """JOI-15: node id of a reference.

    Text that looks like an id must exist among the nodes known by that batch;
    anything else is looked up among the slugs created in the same batch.  Rows without an
    id meet the nodes under a key of their own, so they do not all go to one task.
    """
    low = F.lower(ref)
    by_slug = slugs.select(
        F.col("batch_id").alias("__b"), F.col("slug").alias("__s"), F.col("node_id").alias("__sn")
    )
    by_id = known.select(F.col("node_id").alias("__n"), F.col("since").alias("__since"))
    d = ops.withColumn("__is_id", F.coalesce(F.col(ref).rlike(id_pattern), F.lit(False)))
    d = d.join(by_slug, (F.col("batch_id") == F.col("__b")) & (low == F.col("__s"))
               & ~F.col("__is_id"), "left")
    by_own = F.concat(F.lit("|"), "event_id")
    d = d.join(by_id, F.when(F.col("__is_id"), F.col(ref)).otherwise(by_own) == F.col("__n"), "left")
    seen = F.col("__since").isNull() | (F.col("__since") <= F.struct("batch_time", "batch_id"))
    hit = F.when(F.col("__is_id"), F.when(seen, F.col("__n"))).otherwise(F.col("__sn"))
    return d.withColumn(out, hit).drop("__is_id", "__b", "__s", "__sn", "__n", "__since")


def validate(
    operations: DataFrame, graph: Graph, *, id_pattern: str = UUID_PATTERN + r"|^[0-9a-f]{64}$"
) -> DataFrame:
    """MUT-01: one event per operation, with resolved targets or a rejection reason."""
    ops = complete(operations)
    # The creations feed the slug table, the node table and the result; cutting here
    # computes the alias resolution once.
    created = cut_lineage(_create_nodes(ops, graph.aliases))
    ok = created.filter(F.col("target_node").isNotNull())
    slugs = ok.groupBy("batch_id", F.lower("proposed_id").alias("slug")).agg(
        F.max_by("target_node", "pos").alias("node_id")
    )
    never = F.lit(None).cast("struct<batch_time:timestamp,batch_id:string>")
    known = graph.nodes.select("node_id", never.alias("since")).unionAll(
        ok.filter("event_type = 'create_node'").select(
            F.col("target_node").alias("node_id"),
            F.struct("batch_time", "batch_id").alias("since"),
        )
    )

    def refs(d: DataFrame, ref: str, out: str) -> DataFrame:
        return resolve_refs(d, ref, out, slugs, known, id_pattern)

    updated = refs(ops.filter("operation = 'update_node'"), "target_node_id", "target_node")
    empty = F.coalesce(F.size("field_updates"), F.lit(0)) <= 0
    updated = updated.withColumn(
        "rejection_reason", F.when(F.col("target_node").isNull(), REJECTIONS["target"])
    ).withColumn(
        "event_type",
        F.when(F.col("target_node").isNotNull() & empty, "update_node_noop")
        .otherwise(F.lit("update_node")),
    )

    linked = refs(ops.filter("operation = 'create_edge'"), "source_ref", "source_node_id")
    linked = refs(linked, "target_ref", "target_of_edge")
    reason = (
        F.when(~F.coalesce(F.col("edge_type").isin(vocab.EDGE_TYPES), F.lit(False)),
               REJECTIONS["edge_type"])
        .when(~F.coalesce(F.col("weight_band").isin(vocab.WEIGHT_BANDS), F.lit(False)),
              REJECTIONS["band"])
        .when(_blank(F.col("falsification_criteria")), REJECTIONS["falsification"])
        .when(F.col("source_node_id").isNull(), REJECTIONS["source"])
        .when(F.col("target_of_edge").isNull(), REJECTIONS["target"])
        .when(F.col("source_node_id") == F.col("target_of_edge"), REJECTIONS["self_loop"])
    )
    linked = linked.withColumn("rejection_reason", reason).withColumn(
        "target_edge",
        F.when(F.col("rejection_reason").isNull(),
               F.sha2(F.concat(F.lit("edge|"), F.col("event_id")), 256)),
    ).withColumn("event_type", F.lit("create_edge"))

    known_edges = graph.edges.select(
        F.col("edge_id").alias("__e"), "deprecated", never.alias("__since")
    ).unionAll(
        linked.filter(F.col("target_edge").isNotNull()).select(
            F.col("target_edge").alias("__e"), F.lit(False).alias("deprecated"),
            F.struct("batch_time", "batch_id").alias("__since"),
        )
    )
    on_edges = ops.filter(
        F.col("operation").isin(
            "update_edge_weight", "add_supporting_signal", "add_disconfirming_signal"
        )
    ).join(known_edges, F.col("target_edge_id") == F.col("__e"), "left")
    seen = F.col("__since").isNull() | (F.col("__since") <= F.struct("batch_time", "batch_id"))
    weigh = F.col("operation") == "update_edge_weight"
    bad_band = ~F.coalesce(F.col("new_weight_band").isin(vocab.WEIGHT_BANDS), F.lit(False))
    bad_signal = ~F.coalesce(F.col("signal_id").rlike(id_pattern), F.lit(False))
    reason = (
        F.when(weigh & bad_band, REJECTIONS["band"])
        .when(F.col("__e").isNull() | ~seen, REJECTIONS["edge"])
        .when(weigh & F.col("deprecated"), REJECTIONS["deprecated"])
        .when(~weigh & bad_signal,
              F.concat(F.lit("signal_id is not a valid UUID: '"), F.col("signal_id"), F.lit("'")))
    )
    on_edges = (
        on_edges.withColumn("rejection_reason", reason)
        .withColumn("target_edge", F.when(F.col("rejection_reason").isNull(), F.col("__e")))
        .withColumn("event_type", F.col("operation"))
    )
    return (
        _events(created).unionAll(_events(updated)).unionAll(_events(linked))
        .unionAll(_events(on_edges))
    )


_EVENT_COLUMNS = {
    "event_id": "string", "event_type": "string", "operation": "string", "batch_id": "string",
    "batch_time": "timestamp", "phase": "int", "pos": "long", "target_node": "string",
    "target_edge": "string", "source_node_id": "string", "target_of_edge": "string",
    "node_type": "string", "fields": "map<string,string>", "aliases": "array<string>",
    "field_updates": "map<string,string>", "edge_type": "string", "weight_band": "string",
    "falsification_criteria": "string", "new_weight_band": "string", "direction": "string",
    "signal_id": "string", "reasoning": "string", "source": "string",
    "triggered_by": "array<string>", "rejection_reason": "string",
}


def _events(d: DataFrame) -> DataFrame:
    cols = [
        (F.col(c) if c in d.columns else F.lit(None)).cast(t).alias(c)
        for c, t in _EVENT_COLUMNS.items()
    ]
    return d.select(*cols).withColumn("rejected", F.col("rejection_reason").isNotNull())


# --- fold ----------------------------------------------------------------------------

def applied(events: DataFrame) -> DataFrame:
    """Events that took effect."""
    return events.filter("NOT rejected")


def fold_nodes(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """MUT-03/10: current nodes from stored nodes and events; the last write per key wins."""
    e = applied(events)
    order = F.struct(*_ORDER)
    born = e.filter("event_type = 'create_node'").select(
        F.col("target_node").alias("node_id"), "node_type",
        strip(F.try_element_at("fields", F.lit("name"))).alias("name"),
        F.try_element_at("fields", F.lit("description")).alias("description"),
        type_data(F.col("fields")).alias("type_data"),
        F.col("batch_time").alias("created_at"), F.col("batch_time").alias("updated_at"),
    )
    edits = e.filter("event_type = 'update_node'")
    last = edits.groupBy(F.col("target_node").alias("node_id")).agg(
        F.max_by("batch_time", order).alias("touched")
    )
    per_key = (
        edits.select(F.col("target_node").alias("node_id"), order.alias("o"),
                     F.explode("field_updates").alias("k", "v"))
        .groupBy("node_id", "k").agg(F.max_by(F.struct(F.col("v")), "o").alias("v"))
        # One entry per field name of a node.
        .groupBy("node_id").agg(
            F.map_from_entries(F.collect_list(F.struct("k", F.col("v.v").alias("v")))).alias("u")
        )
    )
    base = nodes.select(*born.columns).unionAll(born)
    out = base.join(per_key, "node_id", "left").join(last, "node_id", "left")
    has = lambda k: F.coalesce(F.map_contains_key("u", k), F.lit(False))
    merged = F.when(
        F.col("u").isNotNull(),
        F.map_concat(
            F.map_filter(F.coalesce("type_data", F.create_map().cast("map<string,string>")),
                         lambda k, v: ~F.array_contains(F.map_keys("u"), k)),
            type_data(F.col("u")),
        ),
    ).otherwise(F.col("type_data"))
    return out.select(
        "node_id", "node_type",
        F.when(has("name"), F.try_element_at("u", F.lit("name"))).otherwise(F.col("name")).alias("name"),
        F.when(has("description"), F.try_element_at("u", F.lit("description")))
        .otherwise(F.col("description")).alias("description"),
        merged.alias("type_data"), "created_at",
        F.coalesce("touched", "updated_at").alias("updated_at"),
    )


def fold_edges(events: DataFrame, edges: DataFrame) -> DataFrame:
    """MUT-04..06/10: current edges with band, update time and signal counts.

    Supporting and disconfirming signals stay rows (see :func:`edge_signals`); an
    edge that gathers very many of them must not become one huge array.  Counts that
    the stored edges carry from earlier folds are added to.
    """
    e = applied(events)
    order = F.struct(*_ORDER)
    born = e.filter("event_type = 'create_edge'").select(
        F.col("target_edge").alias("edge_id"), "source_node_id",
        F.col("target_of_edge").alias("target_node_id"), "edge_type",
        F.col("weight_band").alias("current_weight_band"), "falsification_criteria",
        F.lit(False).alias("deprecated"), F.col("batch_time").alias("created_at"),
        F.col("batch_time").alias("updated_at"),
    )
    kind = F.col("event_type")
    changes = e.filter("phase >= 3").groupBy(F.col("target_edge").alias("edge_id")).agg(
        F.max_by(
            F.when(kind == "update_edge_weight", F.col("new_weight_band")),
            F.when(kind == "update_edge_weight", order),
        ).alias("band"),
        F.max_by("batch_time", order).alias("touched"),
        F.count_if(kind == "add_supporting_signal").alias("n_supporting"),
        F.count_if(kind == "add_disconfirming_signal").alias("n_disconfirming"),
    )
    held = [c for c in ("n_supporting", "n_disconfirming") if c in edges.columns]
    base = edges.select(*born.columns, *[F.col(c).alias(f"held_{c}") for c in held]).unionByName(born, allowMissingColumns=True)
    counted = lambda c: F.coalesce(c, F.lit(0)) + (F.coalesce(f"held_{c}", F.lit(0)) if c in held else F.lit(0))
    return base.join(changes, "edge_id", "left").select(
        "edge_id", "source_node_id", "target_node_id", "edge_type",
        F.coalesce("band", "current_weight_band").alias("current_weight_band"),
        "falsification_criteria", "deprecated", "created_at",
        F.coalesce("touched", "updated_at").alias("updated_at"),
        counted("n_supporting").alias("n_supporting"), counted("n_disconfirming").alias("n_disconfirming"),
    )


def edge_signals(events: DataFrame) -> DataFrame:
    """MUT-06: signals attached to edges, in the order they were added; repeats stay."""
    return applied(events).filter("phase >= 4").select(
        F.col("target_edge").alias("edge_id"), "signal_id",
        (F.col("event_type") == "add_supporting_signal").alias("supporting"), *_ORDER,
    )


def weight_history(events: DataFrame, edges: DataFrame) -> DataFrame:
    """MUT-04/05: weight changes with the band before each of them.

    ``edges`` is the stored state the events apply to; its band is what the first
    change of a stored edge replaces.
    """
    e = applied(events)
    start = e.filter("event_type = 'create_edge'").select(
        F.col("target_edge").alias("edge_id"), "weight_band", F.lit("initial").alias("change_type"),
        *_ORDER,
    )
    change = e.filter("event_type = 'update_edge_weight'").select(
        F.col("target_edge").alias("edge_id"), F.col("new_weight_band").alias("weight_band"),
        F.when(F.col("source") == "disconfirmation", "disconfirmation")
        .when(F.col("direction") == "strengthen", "strengthened")
        .otherwise(F.lit("weakened")).alias("change_type"),
        *_ORDER,
    )
    rows = previous_value(
        start.unionAll(change), ["edge_id"], _ORDER, F.date_trunc("hour", "batch_time"),
        "weight_band", "previous_weight_band",
    )
    stored = edges.select("edge_id", F.col("current_weight_band").alias("stored_band"))
    return (
        rows.join(stored, "edge_id", "left")
        .withColumn("previous_weight_band", F.coalesce("previous_weight_band", "stored_band"))
        .drop("stored_band")
        .withColumnRenamed("batch_time", "content_timestamp")
    )


def value_history(events: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """MUT-02/03: history of ``current_state`` or ``current_assessment`` with the value before."""
    # --- fixed values: node type and first value of each tracked field ---
    node_type, default = {
        "current_state": ("condition", "unknown"),
        "current_assessment": ("claim", "weakly_supported"),
    }[key]
    e = applied(events)
    start = e.filter((F.col("event_type") == "create_node") & (F.col("node_type") == node_type)).select(
        F.col("target_node").alias("node_id"),
        F.coalesce(F.try_element_at("fields", F.lit(key)), F.lit(default)).alias("new_value"),
        *_ORDER,
    )
    change = e.filter(
        (F.col("event_type") == "update_node") & F.map_contains_key("field_updates", key)
    ).select(
        F.col("target_node").alias("node_id"),
        F.try_element_at("field_updates", F.lit(key)).alias("new_value"), *_ORDER,
    )
    rows = previous_value(
        start.unionAll(change), ["node_id"], _ORDER, F.date_trunc("hour", "batch_time"),
        "new_value", "previous_value",
    )
    stored = nodes.select("node_id", F.try_element_at("type_data", F.lit(key)).alias("stored"))
    return (
        rows.join(stored, "node_id", "left")
        .withColumn("previous_value", F.coalesce("previous_value", "stored"))
        .drop("stored")
        .withColumnRenamed("batch_time", "content_timestamp")
    )


def fold_aliases(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """SNK-16: alias table after the events.

    A created entity registers its name and listed aliases and takes over waiting
    aliases of its canonical name; an alias that already has a node keeps it, so
    per alias the earliest node wins.
    """
    made = applied(events).filter("event_type = 'create_node' AND node_type = 'entity'").select(
        strip(F.try_element_at("fields", F.lit("name"))).alias("canonical_name"),
        F.col("target_node").alias("canonical_node_id"), "aliases",
        F.struct(*_ORDER).alias("o"),
    )
    named = made.select(
        F.explode(
            F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
        ).alias("alias_text"),
        "canonical_name", "canonical_node_id", "o",
    )
    waiting = aliases.filter(F.col("canonical_node_id").isNull())
    attached = (
        waiting.select("alias_text", F.lower("canonical_name").alias("k"))
        .join(made.withColumn("k", F.lower("canonical_name")), "k")
        .select("alias_text", "canonical_name", "canonical_node_id", "o")
    )
    first = (
        named.unionAll(attached).groupBy("alias_text")
        .agg(F.min_by(F.struct("canonical_name", "canonical_node_id"), "o").alias("f"))
        .select("alias_text", F.col("f.canonical_name").alias("fn"),
                F.col("f.canonical_node_id").alias("fi"))
    )
    return aliases.select("alias_text", "canonical_name", "canonical_node_id").join(
        first, "alias_text", "full_outer"
    ).select(
        "alias_text",
        F.when(F.col("canonical_node_id").isNull() & F.col("fi").isNotNull(), F.col("fn"))
        .otherwise(F.col("canonical_name")).alias("canonical_name"),
        F.coalesce("canonical_node_id", "fi").alias("canonical_node_id"),
    )


def resolve_names(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """JOI-14: node id of each name by case-insensitive alias, resolved rows only."""
    table = (
        aliases.filter(F.col("canonical_node_id").isNotNull())
        .groupBy(F.lower("alias_text").alias("__k"))
        .agg(F.min(F.struct("canonical_node_id", "canonical_name")).alias("__r"))
    )
    return names.join(table, F.lower(strip(F.col(name))) == F.col("__k")).select(
        *names.columns, "__r.canonical_node_id", "__r.canonical_name"
    )


def batch_totals(events: DataFrame) -> DataFrame:
    """MUT-08: applied, rejected and rejection rate per batch."""
    return events.groupBy("batch_id").agg(
        F.count_if(~F.col("rejected")).alias("n_applied"),
        F.count_if("rejected").alias("n_rejected"),
        (F.count_if("rejected") / F.count(F.lit(1))).alias("rejection_rate"),
    )


def cycle_totals(events: DataFrame, batches: DataFrame) -> DataFrame:
    """MUT-11: totals of a cycle; ``batches`` holds batch_id and n_signals."""
    per = batch_totals(events)
    return batches.join(per, "batch_id", "left").agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.coalesce(F.sum("n_signals"), F.lit(0)).alias("n_signals_processed"),
        F.coalesce(F.sum("n_applied"), F.lit(0)).alias("n_applied"),
        F.coalesce(F.sum("n_rejected"), F.lit(0)).alias("n_rejected"),
    )


def apply_batches(operations: DataFrame, graph: Graph, **options) -> tuple[DataFrame, Graph]:
    """Validate the operations and return (events, graph afterwards)."""
    events = cut_lineage(validate(operations, graph, **options))
    after = Graph(
        fold_nodes(events, graph.nodes),
        fold_edges(events, graph.edges),
        fold_aliases(events, graph.aliases),
    )
    return events, after
