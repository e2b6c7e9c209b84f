"""Clusters of similar claim vectors within a lens (DES-01).

Exact: every pair with cosine above the threshold links its signals.  The angle
between unit vectors is a metric, so with a few pivots a vector can only have
neighbours in cells whose pivot is at most twice the search angle farther away
than its own pivot.  Equal vectors are compared once.  Large cells are cut into
blocks and each pair of blocks is one task, which emits a spanning set of links
rather than all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.operators.components import components

BLOCK = 2000
#: Rows of a block that are compared, or placed, at a time; a task holds one strip of products and one byte a pair.
STRIP = 256


def _useful_pivots(angles, reach: float, copies: float = 4.0) -> int:
    """Largest power of two of pivots that would copy a vector to few cells.

    Judged on the pivots themselves, which are a sample of the vectors.  Without
    such a number one cell is used and blocks alone divide the work.
    """
    k = 1 << (len(angles).bit_length() - 1)
    while k > 1:
        near = angles[:, :k] - angles[:, :k].min(axis=1, keepdims=True) <= reach
        outside = near[k:] if len(near) > k else near
        if outside.sum(axis=1).mean() <= copies:
            return k
        k //= 2
    return 1


def _spanning(x, home, above: float):
    """Smallest row that each row reaches over pairs with a product > ``above`` and a row at home.

    Products are made a strip of rows at a time and only their comparison is kept, one byte a pair.
    """
    import numpy as np

    own = np.flatnonzero(home)
    strips = [slice(at, at + STRIP) for at in range(0, len(own), STRIP)]
    near = np.empty((len(own), len(x)), dtype=bool)
    for part in strips:
        np.greater(x[own[part]] @ x.T, above, out=near[part])
    # Smallest position reachable from each row, spread until nothing changes.
    label, far = np.arange(len(x), dtype=np.int32), np.int32(len(x))
    while len(near):
        low, spread = label[own], label.copy()
        for part in strips:
            low[part] = np.minimum(np.where(near[part], label, far).min(axis=1), low[part])
            np.minimum(spread, np.where(near[part], low[part, None], far).min(axis=0), out=spread)
        spread[home] = np.minimum(spread[home], low)
        if (spread == label).all():
            break
        label = spread
    return label


def vector_links(vectors: DataFrame, *, above: float, pivots: int = 32) -> DataFrame:
    """Links (a, b) that connect all vectors of a lens with cosine > ``above``.

    ``vectors`` holds signal_id (long), lens_no and vector.
    """
    import numpy as np

    d = vectors.withColumn("lens_no", F.col("lens_no").cast("string"))
    same = d.groupBy("lens_no", "vector").agg(F.min("signal_id").alias("rep"))
    copies = d.join(same, ["lens_no", "vector"]).select(
        F.col("signal_id").alias("a"), F.col("rep").alias("b")
    ).filter("a <> b")
    # A fixed number of vectors, chosen by digest, so the set is small and repeatable.
    chosen = [
        r[0] for r in same.orderBy(F.xxhash64("rep"), "rep").limit(pivots).select("vector").collect()
    ]
    if not chosen:
        return copies
    axis = np.asarray(chosen, dtype=np.float64)
    axis /= np.maximum(np.linalg.norm(axis, axis=1, keepdims=True), 1e-300)
    reach = 2.0 * math.acos(max(-1.0, min(1.0, above))) + 1e-6
    axis = axis[: _useful_pivots(np.arccos(np.clip(axis @ axis.T, -1.0, 1.0)), reach)]

    def place(batches: Iterator) -> Iterator:
        import pandas as pd

        for whole in batches:
            for at in range(0, len(whole), 4 * STRIP):
                pdf = whole.iloc[at:at + 4 * STRIP]
                x = np.asarray(pdf["vector"].tolist(), dtype=np.float64)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                pdf, x = pdf[norm[:, 0] > 0], x[norm[:, 0] > 0] / norm[norm[:, 0] > 0]
                if not len(pdf):
                    continue
                angle = np.arccos(np.clip(x @ axis.T, -1.0, 1.0))
                home = angle.argmin(axis=1)
                row, cell = np.nonzero(angle - angle.min(axis=1, keepdims=True) <= reach)
                yield pd.DataFrame({
                    "lens_no": pdf["lens_no"].to_numpy()[row], "cell": cell,
                    "home": cell == home[row], "id": pdf["rep"].to_numpy()[row],
                    "vector": list(x[row]),
                })

    placed = same.mapInPandas(
        place, "lens_no string, cell int, home boolean, id long, vector array<double>"
    )
    sizes = placed.groupBy("lens_no", "cell").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.join(sizes.select("lens_no", "cell", "blocks"), ["lens_no", "cell"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    # A block meets every block of the cell; the pair (i, j) gets the members of both.
    paired = placed.select(
        "lens_no", "cell", "home", "id", "vector", "block", F.explode(others).alias("o")
    ).select(
        "lens_no", "cell", "home", "id", "vector",
        F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"),
    )

    def link(pdf):
        import pandas as pd

        ids = pdf["id"].to_numpy()
        label = _spanning(np.asarray(pdf["vector"].tolist()), pdf["home"].to_numpy(), above)
        moved = label != np.arange(len(ids))
        return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})

    links = paired.groupBy("lens_no", "cell", "i", "j").applyInPandas(link, "a long, b long")
    return links.unionAll(copies).distinct()


def cluster_vectors(vectors: DataFrame, *, above: float = 0.92) -> DataFrame:
    """DES-01: cluster id per signal: the smallest signal id connected by similar vectors."""
    roots = components(vector_links(vectors, above=above))
    return vectors.select("signal_id", "lens_no").join(
        roots, vectors["signal_id"] == roots["node"], "left"
    ).select("signal_id", "lens_no", F.coalesce("root", "signal_id").alias("cluster_id"))
