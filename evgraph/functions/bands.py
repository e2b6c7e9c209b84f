"""Column expressions on bands, states and ordinal weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evgraph import vocab
from evgraph.functions.text import lookup


def band_ord(c: Column) -> Column:
    """Declaration order of a weight band (0 = strong); null for unknown bands."""
    return lookup({b: i for i, b in enumerate(vocab.WEIGHT_BANDS)}, c)


def band_rank(c: Column) -> Column:
    """TOP-03: strong, moderate, weak, everything else."""
    return F.when(c == "strong", 0).when(c == "moderate", 1).when(c == "weak", 2).otherwise(3)


def one_step_weaker(c: Column) -> Column:
    """MUT-09: the next weaker band; null past the last one or for unknown bands."""
    return lookup(dict(zip(vocab.WEIGHT_BANDS, vocab.WEIGHT_BANDS[1:])), c)


def anchor(c: Column) -> Column:
    """Decimal value of a band; null for disputed, which is flagged and not multiplied."""
    return lookup(vocab.BAND_ANCHORS, c).cast("decimal(3,1)")


def is_high(c: Column) -> Column:
    """Strong or moderate."""
    return c.isin("strong", "moderate")


def state_band(active: Column, total: Column) -> Column:
    """DIM-02: band of the active share."""
    share = active / total
    expr = F.when(total == 0, F.lit("unknown"))
    for limit, name in vocab.STATE_BAND_LIMITS:
        expr = expr.when(share < limit, F.lit(name))
    return expr.otherwise(F.lit(vocab.TOP_STATE_BAND))


def attention(band: Column) -> Column:
    """TPC-01: attention tier of a state band."""
    return lookup(vocab.ATTENTION, band, F.lit("low"))
