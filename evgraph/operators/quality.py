"""Row-quality rules and duplicate detection for landed content (FLT-01..05, DED, PRJ)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.functions.text import claim_hash, content_hash, words
from evgraph.operators.ordered import join_summary, top_per_key
from evgraph.session import cut_lineage


def url_chars(content: Column) -> Column:
    """Characters inside web addresses."""
    return F.aggregate(
        F.regexp_extract_all(content, F.lit(vocab.URL_PATTERN), 0),
        F.lit(0),
        lambda total, url: total + F.length(url),
    )


def stock_phrase(content: Column) -> Column:
    """FLT-04: first stock phrase of the list that occurs, else null."""
    low = F.lower(content)
    return F.get(F.filter(words(vocab.STOCK_PHRASES), lambda p: F.contains(low, p)), F.lit(0))


def with_features(fetched: DataFrame) -> DataFrame:
    """Digest, length, characters in links and stock phrase of each content, computed once.

    Everything after this works on these narrow columns; the text itself takes no
    part in grouping or ordering.
    """
    c = F.col("content")
    return (
        fetched.withColumn("content_hash", content_hash(c)).withColumn("__n", F.length(c))
        .withColumn("__links", url_chars(c)).withColumn("__phrase", stock_phrase(c))
    )


def rejection(duplicate: Column) -> Column:
    """FLT-01..05: reason of the first rule that fails, in order; null when accepted."""
    n, links, phrase = F.col("__n"), F.col("__links"), F.col("__phrase")
    return (
        F.when(
            n < vocab.MIN_CONTENT_CHARS,
            F.concat(F.lit("content too short ("), n, F.lit(f" chars < {vocab.MIN_CONTENT_CHARS})")),
        )
        .when(duplicate, F.lit("exact duplicate of already-ingested content"))
        .when(
            links / n > vocab.MAX_LINK_DENSITY,
            F.concat(F.lit("link density too high ("), links, F.lit("/"), n, F.lit(")")),
        )
        .when(
            phrase.isNotNull(),
            F.concat(F.lit("SEO/noise phrase detected: '"), phrase, F.lit("'")),
        )
    )


def check_run(fetched: DataFrame, stored: DataFrame | None, *, now, days: int = 7) -> DataFrame:
    """DED-01/02: quality flags of one run against stored payloads.

    A row is a duplicate when its source stored the same content in the last
    ``days``, or when an earlier accepted row of the run has it.  ``fetched`` holds
    source_id, content, fetched_at and a unique ``arrival``.
    """
    keys = ["source_id", "content_hash"]
    d = _narrow(fetched)
    per_key = d.groupBy(*keys).agg(*_copies())
    if stored is None:
        per_key = per_key.withColumn("__known", F.lit(False))
    else:
        recent = stored.filter(F.col("fetched_at") > F.lit(now) - F.make_dt_interval(F.lit(days)))
        digest = content_hash(F.col("content"))
        if "metadata" in stored.columns:  # written when the payload was stored
            digest = F.coalesce(F.try_element_at("metadata", F.lit("content_hash")), digest)
        known = recent.select("source_id", digest.alias("content_hash")).distinct().withColumn("__known", F.lit(True))
        per_key = per_key.join(known, keys, "left").fillna(False, ["__known"])
    return _flag(fetched, d, per_key, keys)


def check_runs(fetched: DataFrame, *, run: Column, run_start: Column, days: int = 7) -> DataFrame:
    """DED-01/02 over a history of runs: each run sees what earlier runs stored."""
    return check_more_runs(fetched, run=run, run_start=run_start, days=days)[0]


def check_more_runs(
    fetched: DataFrame, *, run: Column, run_start: Column, days: int = 7, memory: DataFrame | None = None,
    remember: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """:func:`check_runs` of later rows: (flagged rows, memory for runs after these).

    Content of a source counts as known when an earlier run stored it within
    ``days`` before the run's start.  Rows are first reduced to one per source,
    content and run; only those are ordered, so copies of one text cost one row
    per run.  ``memory`` holds such rows of runs before these; with ``remember`` the one
    returned keeps what a run that starts no earlier than the last one can still see.
    """
    keys = ["source_id", "content_hash", "__run"]
    d = _narrow(fetched, __run=run, __start=run_start)
    per_key = d.groupBy(*keys).agg(
        *_copies(), F.max("fetched_at").alias("__seen"), F.min("__start").alias("__from")
    )
    if memory is not None:
        per_key = per_key.unionByName(memory).groupBy(*keys).agg(
            F.sum("__copies").alias("__copies"), F.min("__first").alias("__first"),
            F.max("__seen").alias("__seen"), F.min("__from").alias("__from"))
    w = W.partitionBy("source_id", "content_hash").orderBy("__run")
    earlier = F.max("__seen").over(w.rowsBetween(W.unboundedPreceding, -1))
    age = F.make_dt_interval(F.lit(days))
    fresh = F.col("__from") - age
    kept = None
    if remember:
        last = d.agg(F.max("__start")).first()[0]
        kept = per_key if last is None else per_key.filter(F.col("__seen") > F.lit(last) - age)
    per_key = per_key.withColumn("__known", F.coalesce(earlier > fresh, F.lit(False)))
    return _flag(fetched, d, per_key, keys), kept


def _copies() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("__copies"),
        F.min(F.struct("fetched_at", "arrival")).alias("__first"),
    ]


def _narrow(fetched: DataFrame, **more: Column) -> DataFrame:
    """Features, keys and times of each row without its text, written once."""
    rows = with_features(fetched.withColumns(more) if more else fetched)
    return cut_lineage(rows.select(
        "arrival", "source_id", "fetched_at", "content_hash", "__n", "__links", "__phrase", *more))


def _flag(fetched: DataFrame, d: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the reasons.  Only keys that are known or repeated are joined, which are few.

    Reasons are found on narrow rows and joined back by the unique arrival, so a text
    copied very often is no hot key for the texts.  Content that fails another rule is
    never remembered, so its copies fail that rule too.
    """
    notable = per_key.filter("__known OR __copies > 1").select(*keys, "__known", "__first", "__copies")
    d = join_summary(d, notable, keys, "__copies")
    acceptable = rejection(F.lit(False)).isNull()
    later = acceptable & (F.struct("fetched_at", "arrival") > F.col("__first"))
    duplicate = F.coalesce(F.col("__known") | later, F.lit(False))
    judged = d.select(
        F.col("arrival").alias("__a"), F.col("fetched_at").alias("__t"), "content_hash",
        rejection(duplicate).alias("rejected_reason"),
    ).distinct()  # rows that agree in all of these get one verdict
    same = fetched["arrival"].eqNullSafe(F.col("__a")) & fetched["fetched_at"].eqNullSafe(F.col("__t"))
    return fetched.join(judged, same).drop("__a", "__t").withColumn("rejected", F.col("rejected_reason").isNotNull())


def normalise(fetched: DataFrame) -> DataFrame:
    """PRJ-01: payload rows; full digest in the metadata, content time falls back to fetch time."""
    digest = content_hash(F.col("content"))
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    rest = F.map_filter(meta, lambda k, v: k != "content_hash")
    return (
        fetched.withColumn("metadata", F.map_concat(rest, F.create_map(F.lit("content_hash"), digest)))
        .withColumn("content_timestamp", F.coalesce("content_timestamp", "fetched_at"))
        .withColumn(
            "payload_id",
            F.sha2(F.concat_ws("|", "source_id", "url", F.col("fetched_at").cast("string"), digest), 256),
        )
    )


# --- claims ------------------------------------------------------------------------

def dedup_claims(signals: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """DED-03: first signal per claim hash within ``keys`` (one payload), by ``order``."""
    d = signals.withColumn("claim_hash", claim_hash(F.col("claim_text")))
    return top_per_key(d, [*keys, "claim_hash"], [F.col(c) for c in order], 1).drop("claim_hash")


def convergence(signals: DataFrame, by: str = "lens_id") -> DataFrame:
    """DED-04, DES-02/13: claims put forward by more than one distinct ``by`` value.

    A claim copied very often is one row; of payloads only the count is kept, of ``by``,
    which has few values, the set.  With one distinct count Spark does not repeat the rows
    per count, and a digest takes half as many bytes as digits.
    """
    d = signals.select(F.unhex(claim_hash(F.col("claim_text"))).alias("digest"), "payload_id", by, "signal_id")
    found = d.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n_signals"),
        F.countDistinct("payload_id").alias("n_payloads"),
        F.size(F.collect_set(by)).cast("long").alias("n_distinct"),
        F.min("signal_id").alias("first_signal"),
    ).filter("n_distinct > 1")
    return found.select(F.lower(F.hex("digest")).alias("claim_hash"), "n_signals", "n_payloads", "n_distinct", "first_signal")


def convergent_signals(signals: DataFrame) -> DataFrame:
    """DED-04: the signals of convergent claims, with their claim hash."""
    d = signals.withColumn("claim_hash", claim_hash(F.col("claim_text")))
    found = convergence(signals).select("claim_hash", "n_signals")
    return join_summary(d, found, ["claim_hash"], "n_signals", "inner")
