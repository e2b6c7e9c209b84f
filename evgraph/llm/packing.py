"""Best-fit packing with local search over bins that are not full.

Documents are cut into pieces of at most ``capacity`` tokens.  Full pieces are
sequences of their own.  Other pieces are narrow rows (no text) that are dealt at
random to shards of bounded size.  A shard starts from best fit in descending order and
then exchanges pieces between bins: a move, one for one, two for one or one for two,
always so that the sum of squared fills grows, until bins fall empty.  Bins that stay
clearly below capacity are opened again and dealt anew with those of other shards, until
one shard is left or a deal needs as many sequences as the one before it.

Defined cases: a null text is empty, which still has the end id and so one piece; rows
that repeat are packed each; an empty table gives no pieces; other columns are not
carried, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.byte_bpe import DEFAULT, ByteBpe
from evgraph.llm.common import column, slices
from evgraph.session import cut_lineage

CAPACITY = 2048
#: Pieces that one task packs.
SHARD = 40_000
#: A bin with at least this share of its capacity is closed before the next round.
CLOSED = 0.995

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, text: str = "text",
               vocabulary: str = DEFAULT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; only the first may be shorter."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(vocabulary)
        for part in slices(batches, "__text"):
            ids, sizes = bpe.encode(column(part, "__text"))
            whole = np.full(len(ids) + len(sizes), end_id, "<u4")
            ends = np.cumsum(sizes + 1)
            keep = np.ones(len(whole), bool)
            keep[ends - 1] = False
            whole[keep] = ids
            total = sizes + 1
            count = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            rest = total - (count - 1) * capacity
            start = np.where(piece == 0, 0, rest[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, rest[doc], capacity)
            place = (ends - total)[doc] + start
            view = memoryview(whole).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(place.tolist(), (place + length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                 pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("__text")).mapInArrow(pieces, _PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each length: longest first into the fullest bin that has room."""
    bins = np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            b, room, used = used, capacity, used + 1
        bins[i] = b
        left = room - size
        if left:
            if not open_bins[left]:
                rooms |= 1 << left
            open_bins[left].append(b)
    return bins


class _Sums:
    """Values (a size, or the sum of two) and their bins in flat arrays; each bin holds a value once."""

    def __init__(self, per_bin: list[list[int]]):
        self.none = len(per_bin)
        self.spans = [(0, 0)] * len(per_bin)
        self.value, self.home, self.used, self.live = np.zeros(64, np.int64), np.full(64, self.none), 0, 0
        for b, values in enumerate(per_bin):
            self.put(b, values)

    def put(self, b: int, values: list[int]) -> None:
        """Give bin ``b`` new values; what it had stays behind without a bin until the arrays are full."""
        low, high = self.spans[b]
        self.home[low:high] = self.none
        self.live += len(values) - (high - low)
        if self.used + len(values) > len(self.value):
            keep = np.flatnonzero(self.home[: self.used] < self.none)
            room = 2 * (len(keep) + len(values)) + 64
            value, home = np.zeros(room, np.int64), np.full(room, self.none)
            value[: len(keep)], home[: len(keep)] = self.value[keep], self.home[keep]
            starts = np.flatnonzero(np.r_[True, home[1 : len(keep)] != home[: len(keep) - 1]]) if len(keep) else keep
            self.spans = [(0, 0)] * self.none
            for low, high in zip(starts.tolist(), np.r_[starts[1:], len(keep)].tolist()):
                self.spans[int(home[low])] = (low, high)
            self.value, self.home, self.used = value, home, len(keep)
        end = self.used + len(values)
        self.value[self.used : end], self.home[self.used : end] = values, b
        self.spans[b], self.used = (self.used, end), end

    def largest(self, given: np.ndarray, gap: np.ndarray, least: np.ndarray) -> tuple[int, int, int]:
        """(value, value taken for it, bin) where the bin grows most; (0, 0, 0) where none grows by more than ``least``."""
        taken, home = self.value[: self.used], self.home[: self.used]
        offered = given[taken + gap[home]]
        up = np.where(offered - taken > least[home], offered - taken, 0)
        j = int(np.argmax(up)) if len(up) else 0
        return (int(offered[j]), int(taken[j]), int(home[j])) if len(up) and up[j] else (0, 0, 0)


def _pairs(held: dict[int, list[int]]) -> list[int]:
    """Distinct sums of two pieces of a bin."""
    sizes = sorted(held)
    return sorted({a + b for i, a in enumerate(sizes) for b in sizes[i:] if a != b or len(held[a]) > 1})


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Swap pieces between bins with room so that squared fill grows and bins fall empty.

    A bin gives pieces to others: a plain move into a gap, one of its pieces for a shorter
    one, two for one, or one for two.  Every step raises the sum of squared fills, and
    the search ends when no bin has such a step.  A bin of pieces of many sizes has at most some
    sixty distinct ones, so its sums of two are few, and a table of the sums a bin can give
    answers for every piece of the others at once.
    """
    bins = bins.copy()
    filled = np.bincount(bins, weights=lengths).astype(np.int64)
    item = np.flatnonzero((filled < capacity)[bins])
    if not len(item):
        return bins
    names, home = np.unique(bins[item], return_inverse=True)
    held: list[dict[int, list[int]]] = [{} for _ in names]
    for i, b, size in zip(item.tolist(), home.tolist(), lengths[item].tolist()):
        held[b].setdefault(size, []).append(i)
    ones, twos = _Sums([sorted(h) for h in held]), _Sums([_pairs(h) for h in held])
    fill = np.r_[filled[names], 0]  # the last place stands for no bin
    moved = True
    while moved:
        moved = False
        for source in np.argsort(fill[:-1], kind="stable").tolist():
            while fill[source] and (step := _best_step(held, ones, twos, fill, source, capacity)):
                give, take, target = step
                for sizes, a, b in ((give, source, target), (take, target, source)):
                    for size in sizes:
                        i = held[a][size].pop()
                        if not held[a][size]:
                            del held[a][size]
                        held[b].setdefault(size, []).append(i)
                        fill[a] -= size
                        fill[b] += size
                for b in (source, target):
                    ones.put(b, sorted(held[b]))
                    twos.put(b, _pairs(held[b]))
                moved = True
    for b, sizes in enumerate(held):
        for found in sizes.values():
            bins[found] = names[b]
    return bins


def _best_step(held, ones, twos, fill, source, capacity) -> tuple[list[int], list[int], int] | None:
    """(sizes given, sizes taken, bin) with the largest growth of that bin, by kind of step, or None."""
    gap = capacity - fill
    least = np.maximum(0, fill[source] - fill)  # more than this must come in for the squares to grow
    least[[source, -1]] = capacity
    gap[-1] = 0
    single = np.zeros(capacity + 1, np.int64)
    single[list(held[source])] = list(held[source])
    single = np.maximum.accumulate(single)
    offered = np.where(single[gap] > least, single[gap], 0)
    size = int(offered.max())
    if size:  # move into the tightest bin
        return [size], [], int(np.argmin(np.where(offered == size, gap, capacity + 1)))
    give, take, target = ones.largest(single, gap, least)
    if give:
        return [give], [take], target
    sums = [v for v in _pairs(held[source]) if v <= capacity]
    double = np.zeros(capacity + 1, np.int64)
    double[sums] = sums
    give, take, target = ones.largest(np.maximum.accumulate(double), gap, least)
    if give:
        return _two(held[source], give), [take], target
    give, take, target = twos.largest(single, gap, least)
    return ([give], _two(held[target], take), target) if give else None


def _two(held: dict[int, list[int]], total: int) -> list[int]:
    """Sizes of two pieces of a bin with this sum."""
    return next([a, total - a] for a in sorted(held) if total - a in held and (2 * a != total or len(held[a]) > 1))


def pack_shard(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Bin of each piece of one shard."""
    return improve(lengths, best_fit(lengths, capacity), capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Add sequence_id and offset to rows with ``length``; pieces must be written already."""
    names = pieces.columns
    schema = pieces.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                           F.lit(0).cast("double").alias("__fill")).schema

    def packer(round_no: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            lengths = rows["length"].to_numpy(np.int64)
            bins = pack_shard(lengths, capacity)
            order = np.lexsort((np.arange(len(bins)), bins))
            rows, bins, lengths = rows.iloc[order], bins[order], lengths[order]
            ends = np.cumsum(lengths)
            first = np.r_[True, bins[1:] != bins[:-1]]
            begin = (ends - lengths)[first][np.cumsum(first) - 1]
            fill = np.bincount(bins, weights=lengths, minlength=1)[bins] / capacity
            out = rows[names].copy()
            out["sequence_id"] = (np.int64(round_no) << np.int64(52)) + (np.int64(key[0]) << np.int64(24)) + bins
            out["offset"] = ends - lengths - begin
            out["__fill"] = fill
            return out

        return run

    full = pieces.filter(F.col("length") >= capacity).select(
        *names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done = pieces.filter(F.col("length") < capacity), full
    left, round_no, loose, spent = rest.count(), 0, None, 0
    while left:
        n = max(1, -(-left // shard))
        deal = F.pmod(F.xxhash64(F.lit(round_no), *names), F.lit(n)).cast("int")
        packed = cut_lineage(rest.withColumn("__shard", deal).groupBy("__shard").applyInPandas(packer(round_no), schema))
        if loose is not None and packed.filter("offset = 0").count() >= spent:  # not one bin fell empty
            return done.unionByName(loose)
        closed = F.col("__fill") >= CLOSED if n > 1 else F.lit(True)
        done = done.unionByName(packed.filter(closed).select(*names, "sequence_id", "offset"))
        loose = packed.filter(~closed).select(*names, "sequence_id", "offset")
        rest = loose.select(*names)
        left, spent = loose.agg(F.count(F.lit(1)), F.count_if(F.col("offset") == 0)).first()
        round_no += 1
    return done


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, text: str = "text",
                   vocabulary: str = DEFAULT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces of all documents."""
    return pack(cut_lineage(cut_pieces(docs, capacity, end_id, text, vocabulary)), capacity)
