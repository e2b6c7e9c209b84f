"""Readers of landed responses: registry, feeds, pages, search, seismic and series (SRC).

Fetching is not done here.  Each function takes the landed text as a DataFrame
and returns fetch rows with the columns of :data:`FETCH_COLUMNS`.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evgraph.functions.text import strip
from evgraph.operators.ordered import top_per_key

FETCH_COLUMNS = [
    "source_id", "url", "perspective", "content", "fetched_at", "content_timestamp",
    "content_type", "language", "metadata",
]
# --- fixed values: HTTP and feed date pattern ---
HTTP_DATE = "dd MMM yyyy HH:mm:ss z"
ZONED_DATE = "dd MMM yyyy HH:mm:ss Z"

REGISTRY_SCHEMA = (
    "source_id string, canonical_name string, url_base string, tier string, perspective string, "
    "languages array<string>, access_method string, access_config map<string,string>, "
    "update_cadence string, domains array<string>, starting_source_weight double, "
    "enabled boolean, notes string"
)


def load_registry(
    spark: SparkSession, path: str, environment: dict[str, str] | None = None, allowed: Sequence[str] = ()
) -> DataFrame:
    """SRC-01: registry stored as JSON lines, with defaults and variables filled in."""
    return registry_defaults(spark.read.schema(REGISTRY_SCHEMA).json(path), environment, allowed)


def registry_defaults(
    raw: DataFrame, environment: dict[str, str] | None = None, allowed: Sequence[str] = ()
) -> DataFrame:
    """Defaults of missing registry fields; ``$NAME`` and ``${NAME}`` in the base url.

    Values become part of the query plan.  ``environment`` gives them; without it only
    the variables named in ``allowed`` are read from the process.
    """
    env = dict(environment) if environment is not None else {n: os.environ[n] for n in allowed if n in os.environ}
    url = F.coalesce("url_base", F.lit(""))
    names = sorted(n for n in env if re.fullmatch(r"\w+", n))
    table = F.create_map(*[F.lit(x) for n in names for x in (n, env[n])]) if names else None
    if table is not None:
        parts = F.regexp_extract_all(url, F.lit(r"\$\{?\w+\}?|[^$]+|\$"), 0)

        def value(p: Column) -> Column:
            name = F.regexp_replace(p, r"^\$\{?(\w+)\}?$", "$1")
            closed = p.rlike(r"^\$(\{\w+\}|\w+)$")
            return F.when(closed, F.coalesce(F.try_element_at(table, name), p)).otherwise(p)

        url = F.array_join(F.transform(parts, value), "")
    return raw.select(
        "source_id", "canonical_name", url.alias("url_base"),
        F.coalesce("tier", F.lit("2")).alias("tier"),
        F.coalesce("perspective", F.lit("us_eu")).alias("perspective"),
        F.coalesce("languages", F.array(F.lit("en"))).alias("languages"),
        F.coalesce("access_method", F.lit("rss")).alias("access_method"),
        F.coalesce("access_config", F.create_map().cast("map<string,string>")).alias("access_config"),
        F.coalesce("update_cadence", F.lit("daily")).alias("update_cadence"),
        F.coalesce("domains", F.array().cast("array<string>")).alias("domains"),
        F.coalesce("starting_source_weight", F.lit(0.5)).alias("starting_source_weight"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def enabled(registry: DataFrame) -> DataFrame:
    """SRC-02: sources switched on."""
    return registry.filter("enabled")


def source_counts(registry: DataFrame) -> DataFrame:
    """SRC-02: enabled and all sources."""
    return registry.agg(F.count_if("enabled").alias("n_enabled"), F.count(F.lit(1)).alias("n_total"))


def _meta(**values: Column) -> Column:
    pairs: list[Column] = []
    for k, v in values.items():
        pairs += [F.lit(k), v.cast("string")]
    return F.create_map(*pairs)


def _short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def _title_and_text(title: Column, text: Column) -> Column:
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit(""))))


def feed_time(c: Column) -> Column:
    """SRC-04: feed dates in RFC 822 or ISO form; null when neither fits."""
    bare = F.regexp_replace(strip(c), r"^\w+,\s*", "")
    return F.coalesce(
        F.try_to_timestamp(bare, F.lit(ZONED_DATE)),
        F.try_to_timestamp(bare, F.lit(HTTP_DATE)),
        F.try_to_timestamp(strip(c)),
    )


_FEED_ENTRY = (
    "title string, link string, guid string, id string, description string, summary string, "
    "content string, pubDate string, published string, updated string"
)
_FEED = f"channel struct<item:array<struct<{_FEED_ENTRY.replace(' string', ':string')}>>>"


def feed_entries(feeds: DataFrame, sources: DataFrame, per_feed: int = 50) -> DataFrame:
    """SRC-03: first ``per_feed`` entries of each landed feed.

    ``feeds`` holds source_id, feed_url, feed_label, fetched_at and body (the XML).
    """
    d = feeds.join(sources.select("source_id", "perspective", "languages"), "source_id")
    d = d.withColumn("items", F.from_xml("body", _FEED)["channel"]["item"])
    d = d.select("*", F.explode(F.slice("items", 1, per_feed)).alias("e"))
    summary = F.coalesce(
        F.nullif(F.coalesce("e.summary", "e.description"), F.lit("")), "e.content"
    )
    link = F.coalesce("e.link", F.lit(""))
    content = _title_and_text(F.col("e.title"), summary)
    when = F.coalesce(
        feed_time(F.coalesce("e.published", "e.pubDate")), feed_time(F.col("e.updated")), "fetched_at"
    )
    return d.select(
        "source_id", F.when(link != "", link).otherwise(F.col("feed_url")).alias("url"), "perspective",
        content.alias("content"), "fetched_at", when.alias("content_timestamp"),
        F.lit("article").alias("content_type"),
        F.coalesce(F.try_element_at("languages", F.lit(1)), F.lit("en")).alias("language"),
        _meta(
            url=link, headline=F.coalesce("e.title", F.lit("")), feed_label=F.col("feed_label"),
            feed_url=F.col("feed_url"), source_native_id=F.coalesce("e.id", "e.guid", link),
            content_hash=_short_hash(content),
        ).alias("metadata"),
    ).filter("content <> ''")


def header_time(last_modified: Column, date: Column) -> Column:
    """SRC-06: ``Last-Modified``, else ``Date``; the zone is read as UTC."""
    value = F.coalesce(F.nullif(last_modified, F.lit("")), date)
    bare = F.regexp_replace(strip(value), r"^\w+,\s*", "")
    clock = F.regexp_extract(bare, r"^(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.try_to_timestamp(clock, F.lit("d MMM yyyy HH:mm:ss"))


def page_rows(pages: DataFrame) -> DataFrame:
    """SRC-05: fetched web pages as fetch rows.

    ``pages`` holds source_id, perspective, url, body, status_code, fetched_at,
    language, content_language, last_modified and date; the last four may be null.
    """
    header = F.lower(F.substring(strip(F.split("content_language", ",")[0]), 1, 2))
    language = F.coalesce("language", F.nullif(header, F.lit("")), F.lit("en"))
    return pages.select(
        "source_id", "url", "perspective", F.col("body").alias("content"), "fetched_at",
        F.coalesce(header_time(F.col("last_modified"), F.col("date")), "fetched_at")
        .alias("content_timestamp"),
        F.lit("article").alias("content_type"), language.alias("language"),
        _meta(url=F.col("url"), status_code=F.col("status_code"),
              content_hash=_short_hash(F.col("body"))).alias("metadata"),
    )


_SEARCH = (
    "results array<struct<title:string,content:string,url:string,publishedDate:string,engine:string>>"
)


def search_results(responses: DataFrame, per_query: int = 10) -> DataFrame:
    """SRC-07: first results of each landed search response.

    ``responses`` holds source_id, perspective, query, fetched_at and body (JSON).
    """
    d = responses.withColumn("r", F.from_json("body", _SEARCH)["results"])
    d = d.select("*", F.explode(F.slice("r", 1, per_query)).alias("e"))
    content = _title_and_text(F.col("e.title"), F.col("e.content"))
    url = F.coalesce("e.url", F.lit(""))
    return d.select(
        "source_id", url.alias("url"), "perspective", content.alias("content"), "fetched_at",
        F.coalesce(feed_time(F.col("e.publishedDate")), "fetched_at").alias("content_timestamp"),
        F.lit("article").alias("content_type"), F.lit("en").alias("language"),
        _meta(url=url, headline=F.coalesce("e.title", F.lit("")), query=F.col("query"),
              searxng_engine=F.coalesce("e.engine", F.lit("")), source_native_id=url)
        .alias("metadata"),
    ).filter("content <> ''")


_QUAKES = (
    "features array<struct<id:string,geometry:struct<coordinates:array<double>>,"
    "properties:struct<mag:double,place:string,time:string,ids:string,magType:string,url:string,"
    "flynn_region:string,depth:string,unid:string>>>"
)


def _iso(c: Column) -> Column:
    """ISO text of a UTC timestamp, micros only when there are any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""),
                    F.lit("+00:00"))


def quakes_ms(responses: DataFrame) -> DataFrame:
    """SRC-08: GeoJSON of the first provider; times in milliseconds, null magnitudes dropped.

    ``responses`` holds source_id, perspective, request_url, fetched_at and body.
    """
    d = responses.select(
        "*", F.explode(F.from_json("body", _QUAKES)["features"]).alias("f")
    ).select("*", F.col("f.properties").alias("p"), F.col("f.geometry.coordinates").alias("xy"))
    at = lambda i: F.try_element_at("xy", F.lit(i))
    millis = F.try_to_number(F.col("p.time"), F.lit("9999999999999999")).cast("long")
    time = F.when(millis != 0, F.timestamp_millis(millis))
    event = F.coalesce("p.ids", "f.id", F.lit(""))
    scale = F.coalesce("p.magType", F.lit("M"))
    place = F.coalesce("p.place", F.lit("unknown location"))
    head = F.concat(
        F.lit("USGS Earthquake: "), scale, F.format_string("%.1f", "p.mag"), F.lit(" — "), place,
        F.lit("\nTime: "), F.coalesce(_iso(time), F.lit("unknown")), F.lit("\n"),
    )
    tail = F.format_string("Depth: %.1f km\nCoordinates: %.3f°N, %.3f°E\n", at(3), at(2), at(1))
    return d.filter(F.col("p.mag").isNotNull()).select(
        "source_id", F.coalesce("p.url", "request_url").alias("url"), "perspective",
        F.concat(head, F.when(at(3).isNotNull(), tail).otherwise("")).alias("content"), "fetched_at",
        F.coalesce(time, "fetched_at").alias("content_timestamp"),
        F.lit("structured_feed_entry").alias("content_type"), F.lit("en").alias("language"),
        _meta(
            event_id=event, magnitude=F.col("p.mag"), mag_type=scale, place=place, latitude=at(2),
            longitude=at(1), depth_km=at(3), source_native_id=F.concat(F.lit("usgs:"), event),
            raw_properties=F.to_json("p"),
        ).alias("metadata"),
    )


def quakes_iso(responses: DataFrame) -> DataFrame:
    """SRC-09: GeoJSON of the second provider; missing or zero magnitudes dropped.

    Times are ISO text or milliseconds.  Without coordinates a shorter text is used.
    """
    d = responses.select(
        "*", F.explode(F.from_json("body", _QUAKES)["features"]).alias("f")
    ).select("*", F.col("f.properties").alias("p"), F.col("f.geometry.coordinates").alias("xy"))
    at = lambda i: F.try_element_at("xy", F.lit(i))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    place = F.coalesce(filled("p.flynn_region"), filled("p.place"), F.lit("Unknown region"))
    event = F.coalesce(filled("p.unid"), "f.id", F.lit(""))
    millis = F.col("p.time").try_cast("double")
    time = F.coalesce(F.timestamp_millis(millis.cast("long")), F.try_to_timestamp("p.time"))
    depth = F.coalesce("p.depth", F.lit("None"))
    head = F.concat(F.lit("Earthquake detected: M"), F.col("p.mag"), F.lit(" "), place,
                    F.lit(". Depth: "), depth, F.lit(" km."))
    tail = F.concat(
        F.format_string(" Coordinates: %.2fN, %.2fE.", at(2), at(1)), F.lit(" Event ID: "), event,
        F.lit(". Time: "), F.coalesce("p.time", F.lit("None")), F.lit("."),
    )
    return d.filter(F.coalesce("p.mag", F.lit(0.0)) != 0).select(
        "source_id",
        F.concat(F.lit("https://www.seismicportal.eu/eventdetails.html?unid="), event).alias("url"),
        "perspective", F.concat(head, F.when(at(2).isNotNull(), tail).otherwise("")).alias("content"),
        "fetched_at", F.coalesce(time, "fetched_at").alias("content_timestamp"),
        F.lit("structured_feed_entry").alias("content_type"), F.lit("en").alias("language"),
        _meta(event_id=event, magnitude=F.col("p.mag"), depth=F.col("p.depth"), place=place,
              lat=at(2), lon=at(1)).alias("metadata"),
    )


def observations(responses: DataFrame) -> DataFrame:
    """SRC-10: (series_id, ts, value) of landed observation lists; "." and empty values dropped."""
    schema = "observations array<struct<date:string,value:string>>"
    d = responses.select(
        "series_id", F.explode(F.from_json("body", schema)["observations"]).alias("o")
    )
    return d.select(
        "series_id", F.try_to_timestamp("o.date", F.lit("yyyy-MM-dd")).alias("ts"),
        F.col("o.value").try_cast("double").alias("value"),
    ).filter("ts IS NOT NULL AND value IS NOT NULL")


_CHART = (
    "chart struct<result:array<struct<timestamp:array<bigint>,"
    "indicators:struct<quote:array<struct<close:array<double>>>>>>>"
)


def chart_closes(responses: DataFrame) -> DataFrame:
    """SRC-11: (symbol, pos, ts, close) of landed charts, null closes dropped.

    ``last_ts`` is the chart's last timestamp, whether or not it has a close.
    """
    first = F.try_element_at(F.from_json("body", _CHART)["chart"]["result"], F.lit(1))
    d = responses.withColumn("r", first)
    closes = F.try_element_at(F.col("r.indicators.quote"), F.lit(1))["close"]
    last = F.timestamp_seconds(F.try_element_at("r.timestamp", F.lit(-1)))
    d = d.select("symbol", "r", last.alias("last_ts"), F.posexplode(closes).alias("pos", "close"))
    return d.select(
        "symbol", "pos",
        F.timestamp_seconds(F.try_element_at("r.timestamp", F.col("pos") + 1)).alias("ts"),
        "close", "last_ts",
    ).filter("close IS NOT NULL")


def dispatch(readers: dict[str, DataFrame], registry: DataFrame) -> DataFrame:
    """SRC-12: fetch rows of all readers, only of enabled sources; a missing reader adds none."""
    if not readers:
        raise ValueError("no landed input")
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [d.select(*FETCH_COLUMNS) for d in readers.values()],
    )
    return rows.join(enabled(registry).select("source_id"), "source_id", "left_semi")


def replay(payloads: DataFrame, start, end, sources: list[str] | None = None) -> DataFrame:
    """SRC-17: accepted payloads with content time in [start, end].

    Filters reach the scan, and partitions are pruned when the table is
    partitioned by source.  No order is imposed; consumers order what they need.
    """
    d = payloads.filter(F.col("content_timestamp").between(F.lit(start), F.lit(end)) & ~F.col("rejected"))
    return d if sources is None else d.filter(F.col("source_id").isin(sources))


def notable_events(events: DataFrame, limit: int | None = None) -> DataFrame:
    """SRC-18: all events, or the first ``limit`` (1 to 2000) by time."""
    if limit is None:
        return events
    if not 1 <= limit <= 2000:
        raise ValueError("limit must be between 1 and 2000")
    return events.orderBy("occurred_at", "label").limit(limit)


def recent_payloads(payloads: DataFrame, limit: int | None = None, source_id: str | None = None) -> DataFrame:
    """FLT-08: newest accepted payloads with the length of their content."""
    d = payloads.filter(~F.col("rejected"))
    d = d if source_id is None else d.filter(F.col("source_id") == source_id)
    d = d.withColumn("content_length", F.length("content")).drop("content")
    return d if limit is None else d.orderBy(F.col("fetched_at").desc(), "payload_id").limit(limit)


def payloads_without_signals(
    payloads: DataFrame, signals: DataFrame, *, now, hours: int = 2, limit: int | None = None
) -> DataFrame:
    """JOI-06: accepted recent payloads that no signal refers to, newest first."""
    d = payloads.filter(
        ~F.col("rejected") & (F.col("fetched_at") > F.lit(now) - F.make_dt_interval(hours=F.lit(hours)))
    ).join(signals.select("payload_id"), "payload_id", "left_anti")
    return d if limit is None else d.orderBy(F.col("fetched_at").desc(), "payload_id").limit(limit)


def newest_per_series(obs: DataFrame, *, now, lookback_days: int = 45, n: int = 12) -> DataFrame:
    """SER-06: newest ``n`` observations per series within the look-back."""
    recent = obs.filter(F.col("ts") >= F.lit(now) - F.make_dt_interval(F.lit(lookback_days)))
    return top_per_key(recent, ["series_id"], [F.col("ts").desc()], n)
