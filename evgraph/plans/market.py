"""Series moves and the market tape (SER, DES-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.functions.text import grouped_number, lookup, short_number, signed_percent
from evgraph.operators.ordered import top_per_key


def move_by_count(closes: DataFrame, window: int = 5, order: str = "ts") -> DataFrame:
    """SER-01: latest close against the one ``window`` rows earlier, clamped to the oldest.

    Only the newest ``window + 1`` rows per symbol are kept before they are
    compared; null when there are fewer than two or the prior close is zero.
    """
    if window < 1:
        return closes.select("symbol").filter(F.lit(False)).selectExpr(
            "symbol", "0D latest", "0D prior", "0D pct_change", "0L used_window", "0L prior_rank"
        ).drop("prior_rank")
    last = top_per_key(
        closes.select("symbol", order, "close"), ["symbol"], [F.col(order).desc()], window + 1
    )
    d = last.groupBy("symbol").agg(
        F.max_by("close", order).alias("latest"), F.min_by("close", order).alias("prior"),
        (F.count(F.lit(1)) - 1).alias("used_window"),
    )
    d = d.filter("used_window >= 1 AND prior <> 0")
    return d.select("symbol", "latest", "prior", _percent().alias("pct_change"), "used_window")


def move_by_days(obs: DataFrame, days: int = 5) -> DataFrame:
    """SER-02: latest value against the newest one dated at least ``days`` earlier, else the oldest."""
    top = obs.groupBy("symbol").agg(F.max("ts").alias("latest_ts"))
    d = obs.join(top, "symbol")
    target = F.col("latest_ts") - F.make_dt_interval(F.lit(days))
    old = F.col("ts") <= target
    old_ts = F.when(old, F.col("ts"))
    # Fixed-width buffers only, so this is a hash aggregate combined in the map tasks.
    d = d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest_ts"),
        F.max_by("value", "ts").alias("latest"),
        F.coalesce(F.max_by("value", old_ts), F.min_by("value", "ts")).alias("prior"),
        F.coalesce(F.max(old_ts), F.min("ts")).alias("prior_ts"),
    )
    d = d.filter("n >= 2 AND prior <> 0").select(
        "symbol", "latest", "prior", "latest_ts", "prior_ts"
    )
    return d.withColumn("pct_change", _percent())


def _percent() -> Column:
    return (F.col("latest") - F.col("prior")) / F.col("prior") * 100.0


def count_sentence(label: Column, unit: Column) -> Column:
    """SER-03: sentence of a move by count."""
    pct = F.col("pct_change")
    verb = F.when(pct > 0, "rose").when(pct < 0, "fell").otherwise("was flat")
    u = F.when(F.coalesce(unit, F.lit("")) != "", F.concat(F.lit(" "), unit)).otherwise("")
    return F.concat(
        F.lit("Market move: "), label, F.lit(" ("), "symbol", F.lit(") "), verb, F.lit(" "),
        signed_percent(pct), F.lit(" over the last "), "used_window", F.lit(" trading days, "),
        grouped_number(F.col("prior")), u, F.lit(" → "), grouped_number(F.col("latest")), u, F.lit("."),
    )


def days_sentence(label: Column) -> Column:
    """SER-03: sentence of a move by days."""
    pct = F.col("pct_change")
    verb = F.when(pct > 0, "rose").when(pct < 0, "fell").otherwise("was unchanged")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return F.concat(
        F.lit("Market move: "), label, F.lit(" ("), "symbol", F.lit(") "), verb, F.lit(" "),
        signed_percent(pct), F.lit(" between "), day("prior_ts"), F.lit(" and "), day("latest_ts"),
        F.lit(", "), short_number(F.col("prior")), F.lit(" → "), short_number(F.col("latest")), F.lit("."),
    )


def instrument_class(series_id: Column) -> Column:
    """SER-04: instrument class of a series id, empty when unknown."""
    return (
        F.when(series_id.isin(vocab.COMMODITY_SERIES), "commodity")
        .when(series_id.startswith("DEX") | (series_id == "DTWEXBGS"), "currency")
        .when(series_id.isin("SP500", "NASDAQCOM"), "equity_index")
        .when(series_id == "VIXCLS", "volatility")
        .when((series_id == "DGS10") | series_id.startswith("IRLTLT01"), "bond_yield")
        .otherwise("")
    )


def series_label(series_id: Column) -> Column:
    """SER-04: readable name of a series, the id itself when unknown."""
    return lookup(vocab.SERIES_LABELS, series_id, series_id)


def market_tape(payloads: DataFrame, sources: tuple[str, ...] = ("yahoo_finance", "fred")) -> DataFrame:
    """SER-05: newest accepted move per symbol with its place on the tape.

    ``payloads`` carries the metadata map.  Rows are ordered by class, then label.
    """
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    d = payloads.filter(F.col("source_id").isin(*sources) & ~F.col("rejected")).select(
        m("symbol").alias("symbol"), m("label").alias("label"), m("pct_change").alias("pct_change"),
        m("latest_value").alias("value"), F.coalesce(m("instrument_class"), F.lit("")).alias("class"),
        F.col("source_id").alias("source"), F.col("content_timestamp").alias("as_of"), "payload_id",
    ).filter("symbol IS NOT NULL AND pct_change IS NOT NULL")
    rest = ["label", "pct_change", "value", "class", "source", "as_of"]
    d = d.groupBy("symbol").agg(
        F.max_by(F.struct(*rest), F.struct("as_of", "payload_id")).alias("r")
    ).select("symbol", "r.*")
    d = d.withColumn("pct_change", F.col("pct_change").try_cast("double")).withColumn(
        "value", F.col("value").try_cast("double")
    )
    return d.withColumn("class_order", lookup(vocab.INSTRUMENT_ORDER, F.col("class"), F.lit(9))).orderBy(
        "class_order", F.coalesce("label", F.lit("")), "symbol"
    )


def corroborate(moves_a: DataFrame, moves_b: DataFrame, pairs: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """DES-09: whether two providers agree on a series.

    ``pairs`` maps symbol_a to symbol_b; moves agree when their percent changes
    differ by at most ``tolerance`` points.
    """
    a = moves_a.select(F.col("symbol").alias("symbol_a"), F.col("pct_change").alias("pct_a"))
    b = moves_b.select(F.col("symbol").alias("symbol_b"), F.col("pct_change").alias("pct_b"))
    d = pairs.join(a, "symbol_a").join(b, "symbol_b")
    gap = F.abs(F.col("pct_a") - F.col("pct_b"))
    return d.withColumn("verdict", F.when(gap <= tolerance, "agree").otherwise("diverge"))
