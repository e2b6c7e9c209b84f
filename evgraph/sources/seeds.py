"""Seed rows: aliases, starting graph, notable events (SRC-13..15)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.operators.mutate import Graph, apply_batches
from evgraph.session import literal_table

# --- fixed values: (alias, canonical name) ----------------------------------------
ALIASES = [
    ("United States", "United States"), ("USA", "United States"), ("US", "United States"),
    ("America", "United States"), ("United States of America", "United States"),
    ("China", "China"), ("PRC", "China"), ("People's Republic of China", "China"),
    ("Russia", "Russia"), ("Russian Federation", "Russia"),
    ("Germany", "Germany"), ("Federal Republic of Germany", "Germany"),
    ("France", "France"), ("French Republic", "France"),
    ("United Kingdom", "United Kingdom"), ("UK", "United Kingdom"), ("Britain", "United Kingdom"),
    ("Great Britain", "United Kingdom"), ("Japan", "Japan"),
    ("India", "India"), ("Republic of India", "India"),
    ("Brazil", "Brazil"), ("Federative Republic of Brazil", "Brazil"),
    ("Canada", "Canada"), ("Australia", "Australia"),
    ("South Korea", "South Korea"), ("Republic of Korea", "South Korea"), ("Korea", "South Korea"),
    ("Iran", "Iran"), ("Islamic Republic of Iran", "Iran"), ("Persia", "Iran"),
    ("Israel", "Israel"), ("State of Israel", "Israel"),
    ("Saudi Arabia", "Saudi Arabia"), ("Kingdom of Saudi Arabia", "Saudi Arabia"),
    ("KSA", "Saudi Arabia"), ("Ukraine", "Ukraine"),
    ("Turkey", "Turkey"), ("Republic of Turkey", "Turkey"), ("Türkiye", "Turkey"),
    ("Indonesia", "Indonesia"), ("Republic of Indonesia", "Indonesia"),
    ("Pakistan", "Pakistan"), ("Islamic Republic of Pakistan", "Pakistan"),
    ("Nigeria", "Nigeria"), ("Federal Republic of Nigeria", "Nigeria"),
    ("Mexico", "Mexico"), ("United Mexican States", "Mexico"),
    ("European Union", "European Union"), ("EU", "European Union"),
    ("Federal Reserve", "Federal Reserve"), ("Fed", "Federal Reserve"),
    ("US Federal Reserve", "Federal Reserve"), ("Federal Reserve System", "Federal Reserve"),
    ("FOMC", "Federal Reserve"),
    ("European Central Bank", "European Central Bank"), ("ECB", "European Central Bank"),
    ("Bank of England", "Bank of England"), ("BoE", "Bank of England"),
    ("Bank of Japan", "Bank of Japan"), ("BoJ", "Bank of Japan"),
    ("People's Bank of China", "People's Bank of China"), ("PBOC", "People's Bank of China"),
    ("Reserve Bank of India", "Reserve Bank of India"), ("RBI", "Reserve Bank of India"),
    ("Bank of Canada", "Bank of Canada"), ("BoC", "Bank of Canada"),
    ("Reserve Bank of Australia", "Reserve Bank of Australia"),
    ("RBA", "Reserve Bank of Australia"),
    ("Swiss National Bank", "Swiss National Bank"), ("SNB", "Swiss National Bank"),
    ("US Dollar", "US Dollar"), ("USD", "US Dollar"), ("Dollar", "US Dollar"),
    ("Euro", "Euro"), ("EUR", "Euro"),
    ("British Pound", "British Pound"), ("GBP", "British Pound"), ("Sterling", "British Pound"),
    ("Pound Sterling", "British Pound"),
    ("Japanese Yen", "Japanese Yen"), ("JPY", "Japanese Yen"), ("Yen", "Japanese Yen"),
    ("Chinese Yuan", "Chinese Yuan"), ("CNY", "Chinese Yuan"), ("Renminbi", "Chinese Yuan"),
    ("RMB", "Chinese Yuan"), ("Swiss Franc", "Swiss Franc"), ("CHF", "Swiss Franc"),
    ("Canadian Dollar", "Canadian Dollar"), ("CAD", "Canadian Dollar"),
    ("Australian Dollar", "Australian Dollar"), ("AUD", "Australian Dollar"),
    ("Crude Oil", "Crude Oil"), ("Oil", "Crude Oil"), ("Brent Crude", "Crude Oil"),
    ("WTI", "Crude Oil"), ("Natural Gas", "Natural Gas"), ("LNG", "Natural Gas"),
    ("Wheat", "Wheat"), ("Hard Wheat", "Wheat"), ("Soft Wheat", "Wheat"),
    ("Corn", "Corn"), ("Maize", "Corn"),
    ("Soybeans", "Soybeans"), ("Soy", "Soybeans"), ("Soybean", "Soybeans"), ("Rice", "Rice"),
    ("Gold", "Gold"), ("XAU", "Gold"), ("Silver", "Silver"), ("XAG", "Silver"),
    ("Copper", "Copper"), ("Iron Ore", "Iron Ore"), ("Coal", "Coal"), ("Thermal Coal", "Coal"),
    ("OPEC", "OPEC"), ("Organization of the Petroleum Exporting Countries", "OPEC"),
    ("OPEC+", "OPEC+"), ("World Trade Organization", "WTO"), ("WTO", "WTO"),
    ("International Monetary Fund", "IMF"), ("IMF", "IMF"), ("World Bank", "World Bank"),
    ("United Nations", "United Nations"), ("UN", "United Nations"),
    ("NATO", "NATO"), ("North Atlantic Treaty Organization", "NATO"),
    ("Natural Gas Supply", "Natural Gas Supply"), ("Ammonia Production", "Ammonia Production"),
    ("Nitrogen Fertilizer", "Nitrogen Fertilizer"), ("Fertilizer Supply", "Fertilizer Supply"),
    ("Global Crop Yields", "Global Crop Yields"), ("Global Food Prices", "Global Food Prices"),
    ("Food Security", "Food Security"),
]

# --- fixed values: starting graph (slug, type, name, kind or state), links ----------
SEED_TIME = datetime(2022, 2, 24)
SEED_NODES = [
    ("russia", "entity", "Russia", "state"),
    ("ukraine", "entity", "Ukraine", "state"),
    ("natural_gas_supply", "entity", "Natural Gas Supply", "commodity"),
    ("ammonia_production", "entity", "Ammonia Production", "sector"),
    ("nitrogen_fertilizer", "entity", "Nitrogen Fertilizer", "commodity"),
    ("global_crop_yields", "entity", "Global Crop Yields", "sector"),
    ("global_food_prices", "entity", "Global Food Prices", "commodity"),
    ("food_security", "entity", "Food Security", "sector"),
    ("russian_gas_restrictions", "condition", "Russian Gas Export Restrictions", "active"),
    ("ukraine_grain_blockade", "condition", "Ukraine Grain Export Blockade", "active"),
    ("fertilizer_shortage", "condition", "Fertilizer Supply Shortage", "active"),
    ("food_price_inflation", "condition", "Food Price Inflation", "active"),
    ("food_insecurity_crisis", "condition", "Food Insecurity Crisis", "active"),
    ("russia_ukraine_war_2022", "event", "Russia-Ukraine War 2022", "geopolitical"),
]
SEED_EDGES = [
    ("russia_ukraine_war_2022", "russian_gas_restrictions", "enables", "strong"),
    ("russian_gas_restrictions", "ammonia_production", "causes", "strong"),
    ("ammonia_production", "nitrogen_fertilizer", "produces", "moderate"),
    ("nitrogen_fertilizer", "global_crop_yields", "causes", "moderate"),
    ("ukraine_grain_blockade", "global_crop_yields", "constrains", "strong"),
    ("global_crop_yields", "global_food_prices", "causes", "strong"),
    ("global_food_prices", "food_security", "causes", "moderate"),
]

# --- fixed values: notable events (time, label, category) ------------------------------
NOTABLE_EVENTS = [
    (datetime(2022, 2, 24), "Russia invades Ukraine", "geopolitical"),
    (datetime(2022, 8, 26), "European energy crisis peak", "resource"),
    (datetime(2023, 3, 10), "Silicon Valley Bank collapse", "economic"),
    (datetime(2023, 5, 25), "AI capex inflection", "technology"),
    (datetime(2023, 10, 7), "Israel–Gaza war begins", "geopolitical"),
    (datetime(2023, 12, 15), "Red Sea shipping escalation", "resource"),
    (datetime(2024, 8, 5), "Yen carry-trade unwind", "economic"),
]


def seed_aliases(spark: SparkSession, stored: DataFrame) -> DataFrame:
    """SRC-13: seed pairs whose alias is not stored yet, ignoring case; no node attached."""
    seed = literal_table(spark, ALIASES, "alias_text string, canonical_name string")
    new = seed.join(
        stored.select(F.lower("alias_text").alias("k")).distinct(),
        F.lower("alias_text") == F.col("k"), "left_anti",
    )
    return new.withColumn("canonical_node_id", F.lit(None).cast("string"))


def notable_events(spark: SparkSession) -> DataFrame:
    """SRC-15: seeded events, one per time and label."""
    return literal_table(
        spark, NOTABLE_EVENTS, "occurred_at timestamp, label string, category string"
    ).dropDuplicates(["occurred_at", "label"])


def seed_operations(spark: SparkSession) -> DataFrame:
    """SRC-14: the starting graph as one batch of operations."""
    extra = {
        "entity": lambda v: {"entity_kind": v},
        "condition": lambda v: {"current_state": v},
        "event": lambda v: {"event_kind": v, "occurred_at": "2022-02-24T00:00:00Z"},
    }
    nodes = [
        ("seed", SEED_TIME, i, "create_node", slug, kind, {"name": name, **extra[kind](v)},
         None, None, None, None, None)
        for i, (slug, kind, name, v) in enumerate(SEED_NODES)
    ]
    edges = [
        ("seed", SEED_TIME, i, "create_edge", None, None, None, a, b, kind, band,
         f"the link from {a} to {b} stops showing in the data")
        for i, (a, b, kind, band) in enumerate(SEED_EDGES)
    ]
    return literal_table(
        spark,
        nodes + edges,
        "batch_id string, batch_time timestamp, pos long, operation string, proposed_id string, "
        "node_type string, fields map<string,string>, source_ref string, target_ref string, "
        "edge_type string, weight_band string, falsification_criteria string",
    ).withColumn("source", F.lit("seed"))


def load_seed_graph(spark: SparkSession, graph: Graph) -> tuple[DataFrame, Graph]:
    """SRC-14: events and graph after the seed batch."""
    return apply_batches(seed_operations(spark), graph)
