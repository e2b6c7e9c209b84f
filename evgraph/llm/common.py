"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from evgraph.session import ensure_checkpoint_dir

#: Rows of text are handled in slices of about so many bytes, whatever Spark's batch size is.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark from any store."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; an absolute path stays as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def new_folder(spark: SparkSession) -> str:
    """A name in the checkpoint folder that nothing has been written to."""
    return f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back, so that lineage ends
    there and later readers prune columns; ``by`` are columns that become folders."""
    return stored_at(df, *by)[0]


def stored_at(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """:func:`stored` with the folder, for callers that discard it."""
    folder = new_folder(df.sparkSession)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder of :func:`stored_at` that nothing reads any more, in whatever store it is."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """Text column of a batch with null read as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.string()), "")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a slice have about ``size`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, end - start)
            start = end


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text array and where each text starts, with the end as last entry."""
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every (start, length) pair, one after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))
