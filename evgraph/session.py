"""Session settings and the checkpoint folder used by iterative operators."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings every job of this package assumes.  Partition counts and memory are
# left to the cluster; AQE coalesces or splits shuffle partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # State of streams lies on disk within a bound of memory; the default provider keeps all of it on the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply :data:`SETTINGS` to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, preferring the one the cluster names.

    ``spark.checkpoint.dir`` wins.  A folder already set on the context is kept.
    Only a local session may fall back to a temporary folder, because executors
    of a cluster could not read it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back without lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table below the checkpoint folder and read it back without lineage.

    Columns are compressed and readers take those they need, so large rows need a fraction of the disk
    of :func:`cut_lineage`; how rows lie over tasks is not kept.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table as part of the plan, so its size is known to the optimizer.

    Rows are written as one JSON literal.  Without rows the table is an empty
    relation, which lets the optimizer remove joins with it.
    """
    fields = T._parse_datatype_string(schema).fields
    one = spark.range(1)
    if not rows:
        empty = one.filter(F.lit(False))
        return empty.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    names = [f.name for f in fields]
    text = json.dumps([dict(zip(names, r)) for r in rows], default=str)
    kind = T.ArrayType(T.StructType(fields)).simpleString()
    return one.select(F.inline(F.from_json(F.lit(text), kind)))


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Single-row frames with different columns as one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])
