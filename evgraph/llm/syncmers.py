"""Document fingerprints from closed syncmers.

A window of ``K`` bytes is an anchor if the smallest hash of its inner substrings of
``S`` bytes is the first or the last of them.  That depends on the window alone, so the
anchors of a passage are the same wherever it stands.  The fingerprint is all anchors of
a text with their positions, five bytes each, whatever the length of the text; two texts
are as alike as the share of their anchors that match in the order of both.  The likeness
is drawn from what the fingerprint holds and from nothing else: ``likeness`` of two printed
ones, read back, gives it again.  Each text has ``K - 1`` zero bytes in front, so short
texts have windows too.

Documents are dealt to ranges of ids; the first document of the next range is sent along
as a guest, so neighbours meet without one task for all.

Defined cases: null is the empty text, with an empty fingerprint that is like another
empty one only; a text without anchors has one hash of the whole text; documents with
equal ids follow each other by the hash of their text; null ids come last; a single
document is its own next one; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import SLICE_BYTES, column, mix, slices

K, S = 12, 4
#: An anchor as printed: bytes from the anchor before (at most K - S lie between), hash.
_RECORD = np.dtype([("step", "u1"), ("hash", "<u4")])
_LAST_ID = -(1 << 63)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, byte position and text number of every anchor of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    pad = b"\0" * (K - 1)
    raw = b"".join(x for t in texts for x in (pad, t)) + b"\0" * K
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    inner = data[:-3] | data[1:-2] << np.uint32(8) | data[2:-1] << np.uint32(16) | data[3:] << np.uint32(24)
    h = inner * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    w = K - S + 1
    low, have = h, 1
    while have < w:
        step = min(have, w - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    n = len(low)
    edge = (h[:n] == low) | (h[w - 1 : w - 1 + n] == low)
    starts = np.cumsum(sizes + K - 1) - (sizes + K - 1)
    inside = np.zeros(len(raw) + 1, np.int8)  # one window for each byte of a text
    some = sizes > 0
    inside[starts[some]] += 1
    np.add.at(inside, starts[some] + sizes[some], -1)
    at = np.flatnonzero(edge & (np.cumsum(inside[:n]) > 0))
    a = inner[at].astype(np.uint64) | inner[at + 4].astype(np.uint64) << np.uint64(32)
    hashes = mix(mix(a) + inner[at + 8].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    text = np.searchsorted(starts, at, side="right") - 1
    return hashes, at - starts[text] - (K - 1), text


class Print(NamedTuple):
    """All anchors of a text in its order: hashes of 32 bits and byte positions."""

    hashes: np.ndarray
    places: np.ndarray


def fingerprints(texts: list[bytes]) -> list[Print]:
    """The anchors of each text with their positions."""
    hashes, place, text = anchors(texts)
    hashes = (hashes >> np.uint64(32)).astype(np.uint32)
    at = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for i, raw in enumerate(texts):
        own, where = hashes[at[i] : at[i + 1]], place[at[i] : at[i + 1]]
        if not len(own) and raw:
            own = np.frombuffer(hashlib.sha256(raw).digest()[:4], ">u4").astype(np.uint32)
            where = np.full(1, 1 - K)
        out.append(Print(own, where))
    return out


def written(print_: Print) -> str:
    """A fingerprint as text, nothing left out: base64 of its records."""
    records = np.empty(len(print_.hashes), _RECORD)
    records["step"] = np.diff(print_.places, prepend=1 - K)
    records["hash"] = print_.hashes
    return b64encode(records.tobytes()).decode()


def read(text: str) -> Print:
    """The fingerprint that :func:`written` wrote."""
    records = np.frombuffer(b64decode(text), _RECORD)
    return Print(records["hash"].astype(np.uint32), np.cumsum(records["step"], dtype=np.int64) + 1 - K)


def _keys(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers of (hash, how many equal ones stand before), and where each stands."""
    order = np.argsort(hashes, kind="stable")
    own = hashes[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return own.astype(np.uint64) << np.uint64(32) | nth.astype(np.uint64), order


def likeness(a: Print, b: Print) -> float:
    """Share of the anchors that match in hash and place, of all anchors of both texts.

    The n-th anchor with a hash meets the n-th one of the other text; of these pairs the
    longest chain that runs in the order of both texts counts.
    """
    if not len(a.hashes) or not len(b.hashes):
        return float(len(a.hashes) == len(b.hashes))
    (mine, here), (yours, there) = _keys(a.hashes), _keys(b.hashes)
    _, i, j = np.intersect1d(mine, yours, assume_unique=True, return_indices=True)
    places = there[j][np.argsort(here[i])]
    if (np.diff(places) > 0).all():
        met = len(places)
    else:
        ends: list[int] = []
        for p in places.tolist():
            k = bisect_left(ends, p)
            ends[k : k + 1] = [p]
        met = len(ends)
    return met / (len(a.hashes) + len(b.hashes) - met)


def document_anchors(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, hash, position (byte) of every anchor, for matching by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            hashes, place, number = anchors([t.encode() for t in column(part, "__text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(number)), pa.array(hashes.view(np.int64)), pa.array(place)],
                ["doc_id", "hash", "position"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("__text")).mapInArrow(
        run, "doc_id long, hash long, position long")


def _in_ranges(docs: DataFrame) -> DataFrame:
    """Documents by descending id inside id ranges, each range with the first of the next as guest."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("o"))
    share = [i / (2 * parts) for i in range(1, 2 * parts)]
    found = ids.agg(F.percentile_approx("o", share, max(10_000, 40 * parts)).alias("b")).first()["b"]
    bounds = np.unique(np.array(found or [], np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = np.searchsorted(bounds, b.column(0).to_numpy(zero_copy_only=False))
            top = np.full(len(bounds) + 1, _LAST_ID, np.int64)
            np.maximum.at(top, r, b.column(0).to_numpy(zero_copy_only=False))
            seen = np.unique(r)
            yield pa.RecordBatch.from_pydict({"r": seen.astype(np.int32), "top": top[seen]})

    # One row per range; there are twice as many ranges as shuffle partitions.
    tops = sorted(
        (r["r"], r["top"]) for r in ids.mapInArrow(place, "r int, top long").groupBy("r").agg(F.max("top").alias("top")).collect()
    )
    guest_in: dict[int, list[int]] = {}
    for i, (r, _) in enumerate(tops):
        guest_in.setdefault(tops[i - 1][1], []).append(r)  # the lowest range gets the very first document
    heads = np.array(sorted(guest_in), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o = b.column(0).to_numpy(zero_copy_only=False)
            own = pa.array(np.searchsorted(bounds, o).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, own, pa.array(np.zeros(len(o), bool))], ["o", "id", "text", "r", "guest"])
            for i in np.flatnonzero(np.isin(o, heads)).tolist():
                for r in guest_in[int(o[i])]:
                    row = b.slice(i, 1)
                    yield pa.RecordBatch.from_arrays(
                        [*row.columns, pa.array([r], pa.int32()), pa.array([True])], ["o", "id", "text", "r", "guest"])

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("o"), F.col("doc_id").cast("long").alias("id"), "text")
    dealt = rows.mapInArrow(deal, "o long, id long, text string, r int, guest boolean").repartition(parts, "r")
    return dealt.sortWithinPartitions("r", "guest", F.col("o").desc(), F.xxhash64("text"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with both likenesses.

    The edited text has its last half replaced by the beginning of the next document by
    descending id; after the last document comes the first.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        texts = [r[1].encode() for r in rows]
        following = [r[2].encode() for r in rows]
        edited = []
        for _, text, after in rows:
            half = len(text) // 2
            edited.append((text[: len(text) - half] + after[:half]).encode())
        # A document is the next one of the row before it: each text is read once.
        order: dict[bytes, int] = {}
        every = [order.setdefault(t, len(order)) for t in (*texts, *following, *edited)]
        prints = fingerprints(list(order))
        a, b, c = (every[k * len(rows) : (k + 1) * len(rows)] for k in range(3))
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
            pa.array([written(prints[i]) for i in a], pa.string()), pa.array([written(prints[i]) for i in c], pa.string()),
            pa.array([likeness(prints[i], prints[j]) for i, j in zip(a, c)], pa.float64()),
            pa.array([likeness(prints[i], prints[j]) for i, j in zip(a, b)], pa.float64()),
        ], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ready, size = None, [], 0
        for part in slices(batches, "text"):
            text = column(part, "text").to_pylist()
            for o, t, r, guest in zip(part.column(1).to_pylist(), text, part.column(3).to_pylist(), part.column(4).to_pylist()):
                if last is not None and last[2] == r:
                    ready.append((last[0], last[1], t))
                    size += 2 * len(last[1])
                last = None if guest else (o, t, r)
                if size >= SLICE_BYTES:
                    yield judged(ready)
                    ready, size = [], 0
        if ready:
            yield judged(ready)

    return _in_ranges(docs).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
