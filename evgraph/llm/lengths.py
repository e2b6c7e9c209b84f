"""Token counts from an exact histogram of encoded lengths.

Documents are reduced to (length, number of documents) in the map tasks.  Sums from the
long end of the histogram then answer, for any context limit, how many documents reach
it, how many tokens remain when all are cut there, and which length a quantile has.

Defined cases: a null text has length 0; rows that repeat count each; an empty table
gives an empty histogram; columns beside the text take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evgraph.llm.byte_bpe import DEFAULT, ByteBpe
from evgraph.llm.common import column, slices
from evgraph.session import cut_lineage

#: Lengths per block of the two-level sums.
BLOCK = 128


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str = DEFAULT) -> DataFrame:
    """length, n_docs: how many documents encode to each length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(vocabulary)
        for part in slices(batches, "__text"):
            _, sizes = bpe.encode(column(part, "__text"))
            length, n = np.unique(sizes, return_counts=True)
            yield pa.RecordBatch.from_pydict({"length": length.astype(np.int64), "n": n.astype(np.int64)})

    some = docs.select(F.col(text).alias("__text")).mapInArrow(count, "length long, n long")
    return some.groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """length, n_docs, docs_at_least, tokens_at_least, docs_at_most, truncated_total, total_tokens.

    ``truncated_total`` is the number of tokens left when every document is cut to
    ``length``.  Sums run inside blocks of lengths and then over one row per block, so
    no task holds all lengths.
    """
    histogram = cut_lineage(histogram)  # read twice below; texts are encoded once
    h = histogram.withColumn("__b", F.floor(F.col("length") / BLOCK)).withColumn("__t", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("__b").agg(F.sum("n_docs").alias("bn"), F.sum("__t").alias("bt"))
    after = W.orderBy(F.col("__b").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    blocks = blocks.select(
        "__b",
        F.coalesce(F.sum("bn").over(after), F.lit(0)).alias("n_after"),
        F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("t_after"),
        F.sum("bn").over(every).alias("n_all"), F.sum("bt").over(every).alias("t_all"),
    )
    inner = W.partitionBy("__b").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, 0)
    d = h.withColumns({"n_in": F.sum("n_docs").over(inner), "t_in": F.sum("__t").over(inner)}).join(blocks, "__b")
    reach, tokens = F.col("n_in") + F.col("n_after"), F.col("t_in") + F.col("t_after")
    return d.select(
        "length", "n_docs", reach.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("n_all") - reach + F.col("n_docs")).alias("docs_at_most"),
        (F.col("t_all") - tokens + F.col("length") * reach).alias("truncated_total"),
        F.col("t_all").alias("total_tokens"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_longer, truncated_total for each context limit.

    The first length above a limit fixes both; beyond the longest document nothing is cut.
    """
    asked = sums.withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    above = F.when(F.col("length") > F.col("limit"), F.col("length"))
    found = asked.groupBy("limit").agg(
        F.min_by(F.struct("docs_at_least", "tokens_at_least"), above).alias("up"), F.max("total_tokens").alias("__all")
    )
    docs, tokens = F.coalesce("up.docs_at_least", F.lit(0)), F.coalesce("up.tokens_at_least", F.lit(0))
    return found.select("limit", docs.alias("docs_longer"), (F.col("__all") - tokens + docs * F.col("limit")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the smallest length that at least this share of documents does not exceed."""
    total = F.col("docs_at_most") - F.col("n_docs") + F.col("docs_at_least")
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares]))
    reached = sums.select(wanted.alias("share"), "length", "docs_at_most", total.alias("n"))
    return reached.filter(F.col("docs_at_most") >= F.col("share") * F.col("n")).groupBy("share").agg(F.min("length").alias("length"))
