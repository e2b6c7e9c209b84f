"""Nearest neighbours by collision counting over single projections.

Inner products become distances: each vector gets one more component that lifts all to
the largest norm, and each query is scaled to that norm.  A block of vectors keeps one
sorted array per random projection.  A query opens a window around its own projection in
every array and widens all of them level by level (virtual rehashing: no array is built
again).  A vector that lies in at least ``SHARE`` of the windows is verified by its exact
inner product.  What lies in a window is told by each vector's place in the sorted array.  The search in a block ends when the radius of the level covers the
distance of the last neighbour found, or all vectors of the block are verified.

Equal vectors are one entry that keeps the few smallest ids which could appear in a
result; equal queries are searched once.  Queries and vectors meet in blocks of bounded
size, a task sorts a block of vectors once for several blocks of queries, and each block
returns ``k + 1`` entries a query at most.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, neither as queries nor as candidates; vectors of another length are
compared with their like only; ties go to the smaller id; repeated ids count once; with
fewer candidates than ``k`` all are returned; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evgraph.operators.ordered import top_per_key
from evgraph.session import cut_lineage

#: Projections, share of them in which a vector must collide, half window per radius.
PROJECTIONS = 40
SHARE = 0.7
HALF_WINDOW = 1.35
#: First radius as a share of the largest norm, and growth of the radius per level.
FIRST_RADIUS = 0.5
GROWTH = 1.25
#: Entries and queries of a block.
VECTOR_BLOCK = 8_192
QUERY_BLOCK = 1_024
#: Blocks of queries that one task has in memory, to meet a block of vectors that is sent and sorted once.
GROUP_BLOCKS = 8
#: Above this share of a block, one product over all its rows is cheaper than to gather those that collide.
GATHERED = 0.2


class Block:
    """Sorted projections of the vectors of one block."""

    def __init__(self, vectors: np.ndarray, top_norm: float, projections: int = PROJECTIONS, seed: int = 11):
        self.vectors = np.ascontiguousarray(vectors, np.float64)
        self.top = top_norm
        rest = np.sqrt(np.maximum(0.0, top_norm**2 - (self.vectors**2).sum(1)))
        self.axes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections))
        lines = self.vectors @ self.axes[:-1] + rest[:, None] * self.axes[-1]
        order = np.argsort(lines, axis=0, kind="stable")
        self.lines = np.ascontiguousarray(np.take_along_axis(lines, order, 0).T)
        # The place of each entry in each sorted array: a window is a range of places.
        places = np.empty(order.T.shape, np.min_scalar_type(2 * len(vectors)))
        np.put_along_axis(places, order.T, np.arange(len(vectors), dtype=places.dtype)[None, :], 1)
        self.places = places

    def search(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(entries, scores) of the ``k`` best verified entries and their ties for each query."""
        n, m = len(self.vectors), len(self.lines)
        norms = np.sqrt((queries**2).sum(1))
        spots = (queries * (self.top / norms)[:, None]) @ self.axes[:-1]
        need = int(np.ceil(SHARE * m))
        levels = [self._windows(spots, FIRST_RADIUS * self.top)]
        away, inside = np.empty_like(self.places), np.empty(self.places.shape, bool)
        done = []
        for q, query in enumerate(queries):
            level, products = 0, None
            while True:
                if level == len(levels):
                    levels.append(self._windows(spots, levels[-1][0] * GROWTH))
                radius, low, wide = levels[level]
                # Places before a window wrap round to large numbers, so one comparison tells what lies inside.
                np.subtract(self.places, low[q, :, None], out=away)
                np.less(away, wide[q, :, None], out=inside)
                found = np.flatnonzero(np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.uint8) >= need)
                if len(found) >= min(k, n):
                    if products is None and len(found) > GATHERED * n:
                        products = self.vectors @ query
                    scores = self.vectors[found] @ query if products is None else products[found]
                    worst = np.partition(scores, len(found) - min(k, n))[len(found) - min(k, n)]
                    apart = np.sqrt(max(0.0, 2 * self.top**2 - 2 * self.top * worst / norms[q]))
                    if apart <= radius or len(found) == n:
                        keep = scores >= worst
                        done.append((found[keep], scores[keep]))
                        break
                level += 1
        return done

    def _windows(self, spots: np.ndarray, radius: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Radius of a level; first place and number of places in the window of each query and projection."""
        reach = HALF_WINDOW * radius
        low, wide = np.empty((2, *spots.shape), self.places.dtype)
        for j, line in enumerate(self.lines):
            low[:, j] = np.searchsorted(line, spots[:, j] - reach, side="left")
            wide[:, j] = np.searchsorted(line, spots[:, j] + reach, side="right") - low[:, j]
        return radius, low, wide


def query_groups(n_vectors: int, n_queries: int, tasks: int) -> int:
    """Groups of queries that meet each block of vectors; few, as each gets a copy of the block, but enough for all ``tasks``."""
    blocks = max(1, -(-n_vectors // VECTOR_BLOCK))
    most = max(1, -(-n_queries // QUERY_BLOCK))
    return max(-(-most // GROUP_BLOCKS), min(most, -(-tasks // blocks)))


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    number = vector.cast("array<double>")
    bad = F.exists(number, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(number, lambda v: v != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found for each row with ``is_query``."""
    rows = vectors.filter(usable(F.col(vector_col))).filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asks"))
    keyed = rows.withColumn("h", F.xxhash64("v"))
    small = top_per_key(keyed.select("h", "v", "id").distinct(), ["h", "v"], [F.col("id")], k + 1)
    entries = cut_lineage(small.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = cut_lineage(keyed.filter("asks").select("h", "v", "id").distinct())
    # One row per distinct query; all its ids are joined back to the result.
    asking = cut_lineage(asked.groupBy("h", "v").agg(F.min("id").alias("q")))
    n, n_asking = entries.count(), asking.count()
    top = entries.select(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("m")).first()["m"]
    n_v, n_q = max(1, -(-n // VECTOR_BLOCK)), query_groups(n, n_asking, 4 * vectors.sparkSession.sparkContext.defaultParallelism)
    size = F.size("v").alias("d")
    dealt = entries.select("ids", "v", size, F.pmod(F.xxhash64("h", F.lit(1)), F.lit(n_v)).alias("b"),
                           F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("g"))
    calling = asking.select("q", "v", size, F.pmod(F.xxhash64("h", F.lit(2)), F.lit(n_q)).cast("int").alias("g"),
                            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_v - 1).cast("long"))).alias("b"))

    def meet(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(block):
            return pd.DataFrame({"q": [], "vec_id": [], "score": []}).astype({"q": "int64", "vec_id": "int64"})
        index = Block(np.stack(block["v"].to_numpy()), top)
        ids = block["ids"].to_numpy()
        q, v, s = [], [], []
        for at in range(0, len(queries), QUERY_BLOCK):
            some = queries.iloc[at : at + QUERY_BLOCK]
            asked_v = np.ascontiguousarray(np.stack(some["v"].to_numpy()), np.float64)
            for name, (found, score) in zip(some["q"].tolist(), index.search(asked_v, k + 1)):
                hits = [(-float(x), i) for e, x in zip(found.tolist(), score) for i in ids[e].tolist()]
                hits = sorted(hits)[: k + 1]
                q += [name] * len(hits)
                s += [-x for x, _ in hits]
                v += [i for _, i in hits]
        return pd.DataFrame({"q": q, "vec_id": v, "score": s})

    # Bytes say little about the work of a pair of groups, so the number of tasks follows the pairs.
    spread = lambda d: d.repartition(2 * n_v * n_q, "d", "b", "g").groupBy("d", "b", "g")
    met = spread(calling).cogroup(spread(dealt)).applyInPandas(meet, "q long, vec_id long, score double")
    order = [F.col("score").desc(), F.col("vec_id")]
    best = top_per_key(met, ["q"], order, k + 1)
    owners = asked.join(asking.select("h", "v", "q"), ["h", "v"]).select("q", F.col("id").alias("query_id"))
    own = owners.join(best, "q").filter("vec_id <> query_id").select("query_id", "vec_id", "score")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("int")
    return own.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
