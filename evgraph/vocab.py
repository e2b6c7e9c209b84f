"""Vocabularies, thresholds and word lists.

Everything here must equal the values the pipeline is specified with; nothing
is computed.  Small tables are turned into DataFrames by :func:`table`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evgraph.session import literal_table

# --- fixed values: graph vocabulary, in declaration order ---------------------
NODE_TYPES = ["entity", "condition", "event", "quantity", "scenario", "claim"]
EDGE_TYPES = [
    "causes", "enables", "constrains", "accelerates", "correlates_with",
    "contradicts", "refines", "part_of", "produces",
]
WEIGHT_BANDS = ["strong", "moderate", "weak", "provisional", "disputed"]
BAND_ANCHORS = {"strong": "0.8", "moderate": "0.6", "weak": "0.4", "provisional": "0.2"}
CONFIDENCE_BANDS = ["hard_datum", "reported_claim", "inference", "weak_inference"]
CONDITION_STATES = ["active", "inactive", "partially_active", "disputed", "unknown"]
CLAIM_ASSESSMENTS = [
    "well_supported", "partially_supported", "contested", "weakly_supported", "not_supported",
]
EDGE_VERBS = {
    "causes": "causes",
    "enables": "enables",
    "constrains": "constrains",
    "accelerates": "accelerates",
    "correlates_with": "correlates with",
    "contradicts": "contradicts",
    "refines": "refines",
    "part_of": "is part of",
    "produces": "produces",
}
MAX_ANCHORS = 10
MAX_CLAIM_CHARS = 500
MAX_REASONING_CHARS = 1000

# --- fixed values: content rules ----------------------------------------------
MIN_CONTENT_CHARS = 80
MAX_LINK_DENSITY = 0.40
URL_PATTERN = r"https?://\S+"
STOCK_PHRASES = [
    "click here to read more",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "terms of service",
    "privacy policy",
    "all rights reserved",
    "powered by wordpress",
    "cookie policy",
]

# --- fixed values: dimensions and their keywords --------------------------------
DIMENSIONS = [
    "economic_stability",
    "geopolitical_tension",
    "resource_availability",
    "environmental_stress",
    "structural_change",
]
DIMENSION_LABELS = {
    "economic_stability": "Economic Stability",
    "geopolitical_tension": "Geopolitical Tension",
    "resource_availability": "Resource Availability",
    "environmental_stress": "Environmental Stress",
    "structural_change": "Structural Change",
}
DEFAULT_DIMENSION = "structural_change"
DIMENSION_KEYWORDS = {
    "economic_stability": [
        "bank", "credit", "gdp", "inflation", "interest rate", "dollar", "euro",
        "yield", "bond", "equity", "market", "currency", "monetary", "fiscal",
        "employment", "recession", "debt", "capital", "finance", "lending",
        "rate", "economy", "economic", "treasury", "fed ", "ecb ", "imf ",
        "gold reserve", "reserve currency", "payment",
    ],
    "geopolitical_tension": [
        "sanction", "conflict", "war", "military", "alliance", "treaty", "election",
        "political", "government", "diplomacy", "border", "territory", "nuclear",
        "coup", "invasion", "escalation", "ceasefire", "nato", "un ", "g7", "g20",
        "arms", "weapon", "troop", "occupation", "sovereign",
    ],
    "resource_availability": [
        "oil", "gas", "energy", "supply chain", "food", "grain", "fertilizer",
        "commodity", "production", "export", "import", "pipeline", "refinery",
        "crude", "lng", "opec", "wheat", "corn", "soy", "coal", "mining",
        "shipping", "port", "freight", "storage", "inventory", "harvest",
    ],
    "environmental_stress": [
        "earthquake", "flood", "drought", "temperature", "climate", "wildfire",
        "hurricane", "disaster", "storm", "sea level", "emission", "carbon",
        "warming", "deforestation", "glacier", "fire", "extreme weather",
        "pollution", "water stress", "volcanic",
    ],
    "structural_change": [
        "regulation", "law", "legislation", "policy", "reform", "technology",
        "demographic", "infrastructure", "institutional", "digital", "ai ",
        "automation", "demographic", "urbanization", "migration", "population",
        "structural", "geopolitical shift",
    ],
}
STATE_BAND_LIMITS = [
    (0.20, "improving"), (0.40, "stable"), (0.60, "strained"), (0.80, "deteriorating"),
]
TOP_STATE_BAND = "crisis"
ATTENTION = {"crisis": "high", "deteriorating": "high", "strained": "medium"}
BAND_SCORES = {
    "improving": 0.1, "stable": 0.3, "strained": 0.5, "deteriorating": 0.7, "crisis": 0.9,
    "unknown": 0.5,
}
IMPACT_RANKS = {
    "disconfirmation_weakened": 1,
    "edge_strengthened": 2,
    "edge_weakened": 3,
    "condition_activated": 4,
    "condition_deactivated": 5,
    "edge_created": 6,
}

# --- fixed values: outcomes and scores -------------------------------------------
OUTCOME_SCORES = {
    "anchored_strengthened": 1.0,
    "anchored_persistent": 0.3,
    "anchored_weakened": -0.3,
    "anchored_deprecated": -1.0,
    "clustered_but_not_anchored": 0.0,
    "isolated_in_tier_a": -0.2,
    "extraction_rejected": 0.0,
    "pending": 0.0,
}
TIER_BASELINES = {"structured_data": 0.90, "1": 0.80, "2": 0.70, "3": 0.50}
OTHER_BASELINE = 0.5
LEAK_PHRASES = [
    r"as of \d{4}",
    r"by \d{4}",
    r"in \d{4}",
    r"later in \d{4}",
    r"the following year",
    r"subsequently",
    r"later revealed",
    r"would later",
    r"has since",
]

# --- fixed values: lenses (signal cap, node types, edge types in scope) -----------
LENSES = {
    "commodities": (
        10,
        ["entity", "condition", "event", "quantity"],
        ["causes", "constrains", "produces", "part_of", "correlates_with", "accelerates"],
    ),
    "financial": (
        10,
        ["entity", "condition", "event", "quantity", "claim"],
        ["causes", "enables", "constrains", "accelerates", "correlates_with", "contradicts",
         "refines", "part_of", "produces"],
    ),
    "geopolitical": (
        10,
        ["entity", "condition", "event", "claim"],
        ["causes", "enables", "constrains", "accelerates", "correlates_with", "contradicts",
         "refines", "part_of"],
    ),
    "market": (
        8,
        ["condition", "quantity", "entity"],
        ["causes", "correlates_with", "constrains", "accelerates", "part_of"],
    ),
    "physical_world": (8, ["event", "quantity"], ["causes", "correlates_with"]),
    "regulatory": (
        8,
        ["entity", "condition", "event"],
        ["causes", "enables", "constrains", "accelerates", "part_of"],
    ),
    "narrative_divergence": (6, ["claim"], ["contradicts"]),
    "disconfirmation": (5, [], []),
}
CHALLENGE_LENS = "disconfirmation"
ACTIVE_LENSES = [name for name in LENSES if name != CHALLENGE_LENS]

# --- fixed values: market series ---------------------------------------------------
INSTRUMENT_ORDER = {
    "commodity": 0, "currency": 1, "equity_index": 2, "volatility": 3, "bond_yield": 4,
}
COMMODITY_SERIES = [
    "DCOILWTICO", "DCOILBRENTEU", "GOLDPMGBD228NLBM", "GASREGCOVW", "PNGASEUUSDM",
    "PWHEAMTUSDM", "PCORNUSDM", "PSOYBUSDM",
]
SERIES_LABELS = {
    "DCOILWTICO": "WTI Crude Oil Price (USD/barrel)",
    "DCOILBRENTEU": "Brent Crude Oil Price (USD/barrel)",
    "GASREGCOVW": "US Regular Gasoline Price (USD/gallon)",
    "PPIACO": "US Producer Price Index — All Commodities",
    "PWHEAMTUSDM": "World Wheat Price (USD/metric ton)",
    "PCORNUSDM": "World Corn Price (USD/metric ton)",
    "PSOYBUSDM": "World Soybean Price (USD/metric ton)",
    "PNGASEUUSDM": "European Natural Gas Price (USD/MMBtu)",
    "DEXUSEU": "USD/EUR Exchange Rate",
    "DEXCHUS": "CNY/USD Exchange Rate",
    "PET.WTIPUUS.W": "US Weekly Crude Oil Production",
    "NG.N9010US2.W": "US Natural Gas Production",
    "DTWEXBGS": "Broad Trade-Weighted US Dollar Index",
    "DEXJPUS": "JPY/USD Exchange Rate",
    "SP500": "S&P 500 Index",
    "VIXCLS": "CBOE Volatility Index (VIX)",
    "DGS10": "US 10-Year Treasury Yield (%)",
    "GOLDPMGBD228NLBM": "Gold Price, London PM Fixing (USD/oz)",
    "IRLTLT01DEM156N": "Germany 10-Year Government Bond Yield (%)",
    "IRLTLT01GBM156N": "UK 10-Year Government Bond Yield (%)",
    "IRLTLT01JPM156N": "Japan 10-Year Government Bond Yield (%)",
}

# --- fixed values: regions (id, label, perspectives, keywords, lat/lon bounds) --------
REGIONS = [
    ("nordic", "Nordic and Baltic", ["us_eu"],
     ["norway", "sweden", "denmark", "finland", "baltic", "nordic", "nok", "sek", "nok ", "oslo",
      "stockholm", "helsinki", "copenhagen"],
     54.5, 71.5, 4.0, 32.0),
    ("europe_west", "Western Europe", ["us_eu"],
     ["europe", "eu ", "euro", "ecb", "eurozone", "german", "france", "italy", "spain",
      "brussels", "berlin"],
     35.0, 70.0, -10.0, 25.0),
    ("north_america", "North America", ["us_eu"],
     ["united states", "us ", "federal reserve", "fed ", "dollar", "nasdaq", "dow jones",
      "washington", "new york"],
     24.0, 72.0, -170.0, -50.0),
    ("russia", "Russia and Central Asia", ["russia"],
     ["russia", "kremlin", "ruble", "gazprom", "rosneft", "moscow", "putin", "siberia"],
     40.0, 80.0, 30.0, 180.0),
    ("middle_east", "Middle East and Gulf", ["gulf"],
     ["saudi", "iran", "iraq", "opec", "gulf", "hormuz", "riyadh", "tehran", "uae", "abu dhabi",
      "dubai"],
     15.0, 42.0, 34.0, 63.0),
    ("south_asia", "South Asia", ["india"],
     ["india", "pakistan", "sri lanka", "bangladesh", "mumbai", "delhi", "rupee", "rbi ", "modi"],
     5.0, 37.0, 60.0, 100.0),
    ("east_asia", "East and Southeast Asia", ["china", "southeast_asia_pacific"],
     ["china", "beijing", "shanghai", "yuan", "renminbi", "taiwan", "japan", "tokyo",
      "south korea", "asean", "singapore", "brics"],
     -10.0, 55.0, 95.0, 150.0),
    ("global", "Global",
     ["us_eu", "india", "china", "russia", "gulf", "southeast_asia_pacific"], [],
     -90.0, 90.0, -180.0, 180.0),
]
REGION_SCHEMA = (
    "region_id string, display_name string, perspectives array<string>, "
    "entity_keywords array<string>, lat_min double, lat_max double, lon_min double, lon_max double"
)


def regions(spark: SparkSession) -> DataFrame:
    """SRC-15/16: the seeded region table, one row per region id."""
    return literal_table(spark, REGIONS, REGION_SCHEMA).dropDuplicates(["region_id"])


def lens_table(spark: SparkSession) -> DataFrame:
    """FLT-17: lens catalogue with its signal cap and allowed types."""
    rows = [(k, v[0], v[1], v[2], k != CHALLENGE_LENS) for k, v in LENSES.items()]
    return literal_table(
        spark,
        rows,
        "lens_id string, max_signals int, node_scope array<string>, edge_scope array<string>, "
        "active boolean",
    )


def ordinal(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    """A vocabulary with its declaration order, for ordering by enum rather than by text."""
    return literal_table(spark, [(v, i) for i, v in enumerate(values)], f"{name} string, ord int")
