"""Token ids in files: frequency-ranked ids in variable-length coding with separate control bytes.

Ids are replaced by their rank of frequency, so the commonest 256 take one byte and nearly all others two.
Layout of a block, which holds whole documents (all numbers little-endian):

    4 bytes   magic ``EVI1``
    8 + 8     documents, ids (unsigned)
    8 each    ids of each document, end id included
    n/4       control bytes, four ids each: two bits per id, from the lowest, say how many bytes it takes, less one
    rest      the bytes of the ranks, lowest first

Control bytes stand apart from the data, so a block is decoded without a branch: a table of 256 rows gives
four lengths per control byte, their running sum the places, and masks cut each four bytes read to size.

Documents are encoded once into a table in the checkpoint folder; ranks are counted from it, and it is
dealt to ranges of ascending ids, one shard each.  Spark writes shards as Parquet files with a block a
row beside its document ids, so a lost task leaves nothing half written and any store will do; within a
shard each block knows how many ids stand before it.  The order of ranks is a table of its own beside
them, with one row per id of the vocabulary, as is what tasks get handed whole.

Defined cases: a null text is empty and has the end id alone; documents with one id follow each other by
a hash of their ids; null ids come first; special strings inside a text are plain text; a document stays in
one block whatever its length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evgraph.llm.common import column, slices, spread, stored, utf8, vocabulary

DEFAULT, END = "word_bpe_49k.json", 1
MAGIC = b"EVI1"
#: A block is closed when it holds so many ids.
BLOCK_IDS = 1 << 18
#: Words whose ids a worker keeps at hand.
CACHED = 500_000
#: Bytes of text encoded at once; words that repeat in them cost nothing more.
ENCODED = 6 << 20
#: Mark of pieces that end a word (fixed value of the vocabulary).
WORD_END = "</w>"
#: First bytes of the marks U+0300..U+036F in UTF-8.
_COMBINING = np.array([0xCC, 0xCD], np.uint8)
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_LATIN = re.compile(f"[{_LETTERS}]+").fullmatch
_MARK = f"([{_LETTERS}])([.,;:!?])"

#: Bytes taken by each of the four ids of a control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


class WordBpe:
    """Encoder for a vocabulary file; words between plain spaces are encoded once and kept.

    Ids of all kept words lie in one pool; ``known`` has the number of a word, ``start`` and ``size``
    its place.
    """

    _loaded: dict[str, WordBpe] = {}

    def __init__(self, name: str = DEFAULT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.encode_special_tokens = True
        ids = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(ids.values()) + 1, bool)
        self.closes[[i for w, i in ids.items() if w.endswith(WORD_END)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint32)
        self.start = self.size = np.zeros(0, np.int64)

    @classmethod
    def load(cls, name: str = DEFAULT) -> WordBpe:
        """One encoder per worker process."""
        if name not in cls._loaded:
            cls._loaded[name] = cls(name)
        return cls._loaded[name]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of Latin letters, encoded in one call: each ends with its only closing piece."""
        ids = self._ids([" ".join(words)])[0]
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) == len(words):
            return ids, np.diff(np.r_[0, ends])
        found = self._ids(words)
        return np.concatenate(found), np.array([len(f) for f in found], np.int64)

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of new words."""
        plain, rest = [], []
        for w in words:
            (plain if _LATIN(w) else rest).append(w)
        pools, sizes = [self.pool], [self.size]
        if plain:
            ids, size = self._plain(plain)
            pools.append(ids)
            sizes.append(size)
        found = self._ids(rest)
        pools += found
        sizes.append(np.array([len(f) for f in found], np.int64))
        self.known.update(zip((*plain, *rest), range(len(self.known), len(self.known) + len(words))))
        self.pool, self.size = np.concatenate(pools), np.concatenate(sizes)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has.

        The tokenizer drops white space, takes a line end for a space, and no pattern of it goes on from a
        Latin letter to a mark, so spaces put between those change nothing and the parts between spaces
        encode alone as they do in the text.  Parts that begin with what may join the sign before
        make their text be encoded whole.
        """
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        apart = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), _MARK, r"\1 \2")
        if not np.isin(utf8(texts)[0], _COMBINING).any():  # they join some small letters whose capitals they do not
            apart = pc.ascii_lower(apart)
        parts = pc.split_pattern(apart, " ")
        at = np.asarray(parts.offsets, np.int64)
        at = at - at[0]
        coded = parts.flatten().dictionary_encode()
        codes = np.asarray(coded.indices, np.int64)
        words = coded.dictionary.to_pylist()
        if len(self.known) > CACHED:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[codes]
        starts, size = self.start[number], self.size[number]
        pool = self.pool
        odd = np.array([not w[:1].isascii() and not w[0].isalnum() for w in words], bool)
        whole = np.add.reduceat(odd[codes].astype(np.int64), at[:-1]) > 0
        if whole.any():
            found = self._ids([texts[int(i)].as_py() for i in np.flatnonzero(whole)])
            own = np.array([len(f) for f in found], np.int64)
            size[np.repeat(whole, np.diff(at))] = 0
            first = at[:-1][whole]
            starts[first], size[first] = len(pool) + np.cumsum(own) - own, own
            pool = np.concatenate([pool, *found])
        return pool[spread(starts, size)], np.add.reduceat(size, at[:-1])


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    size = np.ones(len(ranks), np.int64)
    for bits in (8, 16, 24):
        size += ranks >= np.uint32(1 << bits)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    taken = np.arange(4) < size[:, None]
    return control.tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[taken].tobytes()


def unpack_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The numbers again: lengths from the table, places from their sum, four bytes read and cut."""
    size = LENGTHS[control].reshape(-1)[:n]
    place = np.cumsum(size) - size
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    four = data[place].astype(np.uint32)
    for k in (1, 2, 3):
        four |= data[place + k].astype(np.uint32) << np.uint32(8 * k)
    return four & MASKS[size]


def write_block(ranks: np.ndarray, lengths: np.ndarray) -> bytes:
    """One block with the documents of these lengths."""
    control, data = pack_ranks(ranks)
    head = np.array([len(lengths), len(ranks)], "<u8").tobytes()
    return b"".join([MAGIC, head, lengths.astype("<u8").tobytes(), control, data])


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and lengths of the documents of a block."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n = np.frombuffer(block, "<u8", 2, 4).astype(np.int64).tolist()
    lengths = np.frombuffer(block, "<u8", docs, 20).astype(np.int64)
    control = np.frombuffer(block, np.uint8, -(-n // 4), 20 + 8 * docs)
    data = np.frombuffer(block, np.uint8, offset=20 + 8 * docs + len(control))
    return unpack_ranks(control, data, n), lengths


def _encoded(docs: DataFrame, text: str, vocabulary: str, end: int) -> DataFrame:
    """doc_id, ids (end id last, little-endian, two bytes each or four if ``wide``) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.load(vocabulary)
        for part in slices(batches, "__text", ENCODED):
            ids, sizes = bpe.encode(column(part, "__text"))
            wide = max(ids.max(initial=0), end) >= 1 << 16
            full = np.full(len(ids) + len(sizes), end, "<u4" if wide else "<u2")
            place = np.cumsum(sizes + 1)
            own = np.ones(len(full), bool)
            own[place - 1] = False
            full[own] = ids
            offsets = pa.py_buffer(np.concatenate([[0], full.itemsize * place]).astype(np.int64))
            raw = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, offsets, pa.py_buffer(full)])
            flags = pa.array(np.full(len(sizes), wide))
            yield pa.RecordBatch.from_arrays([part.column(0), flags, raw.cast(pa.binary())], ["doc_id", "wide", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("__text")).mapInArrow(run, "doc_id long, wide boolean, ids binary")


def _narrow(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Ids of each row of a batch that ends with ``wide`` and ``ids``."""
    for wide, raw in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1)):
        yield np.frombuffer(raw.as_buffer(), "<u4" if wide else "<u2")


def _counted(encoded: DataFrame) -> DataFrame:
    """id, n: occurrences of each id, one row per id that occurs; summed per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for ids in _narrow(b):
                n = np.bincount(ids, minlength=len(total))
                n[: len(total)] += total
                total = n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": ids.astype(np.int64), "n": total[ids]})

    return encoded.select("wide", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _in_order(ranks: DataFrame) -> np.ndarray:
    """Ids by rank; one entry per id of the vocabulary at most."""
    found = ranks.orderBy("rank").select("id").toPandas()
    return found["id"].to_numpy(np.int64)


def write_ids(docs: DataFrame, folder: str, text: str = "text", vocabulary: str = DEFAULT, end: int = END) -> None:
    """Write the ids of all documents, in ascending doc_id order, below ``folder`` (``ranks`` and ``blocks``)."""
    spark = docs.sparkSession
    encoded = stored(_encoded(docs, text, vocabulary, end).select("*", F.monotonically_increasing_id().alias("__row")))
    rank = F.row_number().over(W.orderBy(F.col("n").desc(), "id")) - 1
    _counted(encoded).select(rank.alias("rank"), "id", "n").write.parquet(f"{folder}/ranks")
    by_rank = _in_order(spark.read.parquet(f"{folder}/ranks"))
    rank_of = np.zeros(int(by_rank.max(initial=-1)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    handed = spark.sparkContext.broadcast(rank_of)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, number = TaskContext.get().partitionId(), 0, 0
        kept: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def block() -> pa.RecordBatch:
            lengths = np.array([len(ids) for _, ids in kept], np.int64)
            raw = write_block(handed.value[np.concatenate([ids for _, ids in kept])], lengths)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int64()), "before": pa.array([before], pa.int64()),
                "n_ids": pa.array([size], pa.int64()), "doc_ids": pa.array([[i for i, _ in kept]], pa.list_(pa.int64())), "payload": pa.array([raw], pa.binary())})

        for b in batches:
            for id_, ids in zip(b.column(0).to_pylist(), _narrow(b)):
                kept.append((id_, ids.copy()))
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield block()
                    before, number, kept, size = before + size, number + 1, [], 0
        if kept:
            yield block()

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "__h", "__row"]  # one id may hold many rows: they spread over shards by hash and row
    ranged = encoded.withColumn("__h", F.xxhash64("ids")).repartitionByRange(shards, *keys).sortWithinPartitions(*keys)
    blocks = ranged.select("doc_id", "wide", "ids").mapInArrow(
        write, "shard int, block long, before long, n_ids long, doc_ids array<long>, payload binary")
    blocks.write.parquet(f"{folder}/blocks")


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with ``start``, the number of ids in all blocks before; one sum per shard is handed to tasks."""
    blocks = spark.read.parquet(f"{folder}/blocks")
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    base = sums.select("shard", F.coalesce(before, F.lit(0)).alias("__base"))
    return blocks.join(F.broadcast(base), "shard").withColumn("start", F.col("__base") + F.col("before"))


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start, ids (array) of every document in the files; with ``digest`` their number and crc32 instead."""
    handed = spark.sparkContext.broadcast(_in_order(spark.read.parquet(f"{folder}/ranks")).astype("<u4"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "payload"):
            for doc_ids, start, raw in zip(part.column(0), part.column(1).to_pylist(), part.column(2)):
                ranks, lengths = read_block(raw.as_py())
                ids = handed.value[ranks]
                ends = np.cumsum(lengths)
                cols = {"doc_id": doc_ids.values, "start": pa.array(start + ends - lengths)}
                if digest:
                    view = memoryview(ids.view(np.uint8))
                    crc = [zlib.crc32(view[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), lengths.tolist())]
                    cols |= {"n_tokens": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64())}
                else:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(cols)

    rows = _blocks(spark, folder).select("doc_ids", "start", "payload")
    kept = "n_tokens long, ids_crc32 long" if digest else "ids array<long>"
    return rows.mapInArrow(read, f"doc_id long, start long, {kept}")
