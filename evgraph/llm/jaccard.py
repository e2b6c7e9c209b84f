"""Jaccard join on word n-grams: rare-first prefixes, verified once per pair.

1. Documents are dealt to blocks by id.  A block asks, per range of shingle hashes, for
   the number of documents that hold each of its shingles; the ranges answer with one
   byte a shingle (a logarithmic step of the exact count).  Texts are shuffled once.
2. With these counts a document's shingles are ordered rare first (count step, then
   hash).  Two sets above the threshold share a shingle of their prefixes, so only
   prefix entries that some other document holds at all are written; most documents
   have none.  Equal sets are one node.
3. Rounds of pivots: in every list of nodes with the same prefix shingle each node meets
   one pivot of another component.  That links the members of a large group in a number
   of pairs that grows with the group, not with its square.  Each node is verified with
   the pivot it shares most shingles with.
4. All pairs of a list whose components still differ pass the length, position and suffix
   filters and are verified, so no link between components is lost.
5. Links join rows of one component only, so the links of each row are counted inside
   the components: every pair of nodes that the length filter leaves is compared once,
   as a product of incidence matrices.  Large components are cut into blocks; a task
   compares two blocks and emits one count a node, never a row a pair.

Defined cases: null or blank texts have an empty set and are linked with nothing; texts
with fewer words than a shingle have one; equal rows are copies of one node and each is
returned; a null id takes no part in the smallest id; an empty table gives no rows;
other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import column, discard, mix, slices, stored, stored_at, utf8
from evgraph.operators.components import components
from evgraph.session import cut_lineage

#: Documents of a block and of a hash range.
BLOCK_DOCS = 2_000
#: Pivot rounds before the remaining pairs are listed.
ROUNDS = 3
#: Nodes and shingles of a block of a large component, and shingles whose columns are multiplied at once.
LINK_NODES, LINK_SHINGLES, LINK_COLUMNS = 1_000, 500_000, 4_096
_KEY_BITS = 48
_PARITY = 256
_PARITY_COLUMNS = ("s0", "s1", "s2", "s3")
_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
#: Spark's rows with one schema for the three kinds of output of a block.
_ROWS = ("kind int, doc_id long, digest long, sig long, size int, h long, pos int, s0 long, s1 long, s2 long, s3 long, shingles binary")


class _Words:
    """Hashes of lower-cased words of UTF-8 texts; A-Z only, split at space and tab to carriage return."""

    def __init__(self):
        rng = np.random.default_rng(7)
        self.code = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.code[ord("A") : ord("Z") + 1] = self.code[ord("a") : ord("z") + 1]
        self.gap = np.zeros(256, bool)
        self.gap[[32, *range(9, 14)]] = True
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n + 1:
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE)], dtype=np.uint64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts and how many each has."""
        data, offsets = utf8(texts)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        self._powers(n)
        gap = self.gap[data]
        fresh = np.zeros(n + 1, bool)
        fresh[offsets] = True
        starts = np.flatnonzero(~gap & (fresh[:-1] | np.r_[True, gap[:-1]]))
        ends = np.flatnonzero(~gap & (fresh[1:] | np.r_[gap[1:], True])) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.code[data] * self.power[:n], out=total[1:])
        words = mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        return words, np.diff(np.searchsorted(starts, offsets))


_words: list[_Words] = []


def shingle_sets(texts: pa.Array, width: int = 4) -> list[np.ndarray]:
    """Distinct shingle hashes of each text in ascending order."""
    if not _words:
        _words.append(_Words())
    words, counts = _words[0](texts)
    rolled = words.copy()
    for k in range(1, width):
        later = np.r_[words[k:], np.zeros(min(k, len(words)), np.uint64)]
        rolled = mix(rolled * np.uint64(0x9FB21C651E98DF25) + later)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            h = np.uint64(n)
            for w in words[at : at + n]:
                h = _step(h, w)
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _step(h: np.uint64, w: np.uint64) -> np.uint64:
    value = (int(h) * 0x2545F4914F6CDD1D + int(w)) & 0xFFFFFFFFFFFFFFFF
    return mix(np.array([value], np.uint64))[0]


def _block_sets(block: pa.Table, width: int) -> list[np.ndarray]:
    sets: list[np.ndarray] = []
    for part in slices(iter(block.to_batches()), "text", 2 << 20):
        sets += shingle_sets(column(part, "text"), width)
    return sets


def _pack(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte plane, compressed."""
    gaps = np.diff(values, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _requests(sets: list[np.ndarray], ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a block, how many documents hold each, and where each range starts."""
    every = np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(64 - _KEY_BITS)
    keys, counts = np.unique(every, return_counts=True)
    width = -(-(1 << _KEY_BITS) // ranges)
    bounds = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(width))
    return keys, counts, bounds


def _count_steps(totals: np.ndarray) -> np.ndarray:
    """One byte that never falls as the count grows: 0 for one document, 8 for two, 16 for four."""
    return np.minimum(255, np.floor(8 * np.log2(totals))).astype(np.uint8)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _schema(ddl_fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in ddl_fields])


_OUT = _schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("sig", pa.int64()), ("size", pa.int32()), ("h", pa.int64()),
                ("pos", pa.int32()), *((c, pa.int64()) for c in _PARITY_COLUMNS), ("shingles", pa.binary())])


def _describe(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Kind 0: node of each document; 1: prefix entries of a node; 2: the set of a node with entries."""
    n = docs.count()
    blocks = max(1, -(-n // BLOCK_DOCS))
    ranges = max(1, -(-n // (2 * BLOCK_DOCS)))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"), F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).alias("block"))

    def ask(block: pa.Table) -> pa.Table:
        keys, counts, at = _requests(_block_sets(block, width), ranges)
        some = [r for r in range(ranges) if at[r + 1] > at[r]]
        return pa.table({
            "range": pa.array(some, pa.int32()),
            "block": pa.array([block.column("block")[0].as_py()] * len(some), pa.int64()),
            "keys": pa.array([_pack(keys[at[r] : at[r + 1]]) for r in some], pa.binary()),
            "counts": pa.array([zstandard.compress(counts[at[r] : at[r + 1]].astype(np.uint32).tobytes(), 1) for r in some], pa.binary()),
        })

    def answer(asked: pa.Table) -> pa.Table:
        keys = [_unpack(k.as_py()) for k in asked.column("keys")]
        counts = [np.frombuffer(zstandard.decompress(c.as_py()), np.uint32) for c in asked.column("counts")]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        steps = _count_steps(np.bincount(place, weights=np.concatenate(counts)))[place]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pa.table({
            "block": asked.column("block"), "range": asked.column("range"),
            "steps": pa.array([zstandard.compress(s.tobytes(), 1) for s in np.split(steps, cuts)], pa.binary()),
        })

    def describe(block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _OUT.empty_table()
        sets = _block_sets(block, width)
        keys, _, _ = _requests(sets, ranges)
        order = np.argsort(answers.column("range").to_numpy())
        parts = [np.frombuffer(zstandard.decompress(answers.column("steps")[int(i)].as_py()), np.uint8) for i in order]
        steps = np.concatenate([np.zeros(0, np.uint8), *parts])
        return _rows(block.column("doc_id").to_pylist(), block.column("digest").to_pylist(), sets, keys, steps, percent)

    asked = rows.groupBy("block").applyInArrow(ask, "range int, block long, keys binary, counts binary")
    answers = asked.groupBy("range").applyInArrow(answer, "block long, range int, steps binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(describe, _ROWS)


def _part(kind: int, **columns) -> pa.Table:
    """Rows of one kind; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.table([
        (pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name])
        if f.name in columns else pa.nulls(n, f.type) for f in _OUT], schema=_OUT)


def _rows(ids: list, digests: list, sets: list[np.ndarray], keys: np.ndarray, steps: np.ndarray, percent: int) -> pa.Table:
    sizes = np.array([len(s) for s in sets], np.int32)
    sigs = [int(mix(np.array([mix(s).sum() + np.uint64(len(s))]))[0].view(np.int64)) if len(s) else None for s in sets]
    seen, owners, blobs = set(), [], []
    h, pos, suffix, times = [], [], [], []
    for k, (sig, s) in enumerate(zip(sigs, sets)):
        if sig is None or sig in seen:
            continue
        seen.add(sig)
        step = steps[np.searchsorted(keys, s >> np.uint64(64 - _KEY_BITS))]
        order = np.argsort(step, kind="stable")  # the set ascends by hash already
        prefix = order[: prefix_length(len(s), percent)]
        shared = np.flatnonzero(step[prefix] > 0)
        if not len(shared):
            continue
        bucket = (s >> np.uint64(3)).astype(np.int64) % _PARITY
        passed = np.zeros((len(prefix), _PARITY), np.uint8)
        passed[np.arange(len(prefix)), bucket[prefix]] = 1
        behind = (np.bincount(bucket, minlength=_PARITY) - np.cumsum(passed, axis=0, dtype=np.int64)[shared]) & 1
        suffix.append(np.packbits(behind.astype(np.uint8), axis=1).view(np.int64))
        h.append(s[prefix[shared]])
        pos.append(shared)
        times.append(len(shared))
        owners.append(k)
        blobs.append(_pack(s))
    parts = [_part(0, doc_id=ids, digest=digests, sig=sigs, size=sizes)]
    if owners:
        own_sig = np.array([sigs[k] for k in owners], np.int64)
        parity = np.concatenate(suffix)
        parts.append(_part(2, sig=own_sig, size=sizes[owners], shingles=blobs))
        parts.append(_part(
            1, sig=np.repeat(own_sig, times), size=np.repeat(sizes[owners], times), h=np.concatenate(h).view(np.int64),
            pos=np.concatenate(pos).astype(np.int32), **{c: parity[:, i] for i, c in enumerate(_PARITY_COLUMNS)}))
    return pa.concat_tables(parts)


def _needed(x: Column, y: Column, percent: int) -> Column:
    """Smallest intersection of two sets of these sizes at the threshold: 100 i >= percent (x + y - i)."""
    return F.ceil(percent * (x + y) / (100 + percent))


def _pass_filters(percent: int) -> Column:
    """Length, position and suffix filter of entries x and y with the same shingle.

    The suffix filter takes the shingles behind an entry as a parity vector: each shingle
    that only one of the two has flips one bit of their sum, so the set bits are no more
    than the shingles that differ.  The position bound and the suffix bound hold at the
    first shingle that two sets share; there both entries exist, so a similar pair always
    passes in that list.
    """
    x, y = F.col("x"), F.col("y")
    need = _needed(x["size"], y["size"], percent)
    left_x, left_y = x["size"] - x["pos"] - 1, y["size"] - y["pos"] - 1
    apart = sum((F.bit_count(x[c].bitwiseXOR(y[c])) for c in _PARITY_COLUMNS), F.lit(0))
    return (
        (100 * F.least(x["size"], y["size"]) >= percent * F.greatest(x["size"], y["size"]))
        & (1 + F.least(left_x, left_y) >= need)
        & (apart <= left_x + left_y - 2 * (need - 1))
    )


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked of every pair (a, b) of nodes, by the exact sizes of intersection and union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            ok = []
            for sa, sb in zip(rows["sa"], rows["sb"]):
                x, y = _unpack(sa), _unpack(sb)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pd.DataFrame({"a": rows["a"], "b": rows["b"], "linked": np.array(ok, bool)})

    first = sets.select(F.col("sig").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("sig").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(first, "a").join(second, "b").mapInPandas(run, "a long, b long, linked boolean")


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """sig, label with the labels of linked nodes brought together.

    Each label hooks to the smallest label it is linked with and then follows that one's
    hook, twice, which joins what meets one pivot.  Labels only spare comparisons, so
    they need not be whole components yet.
    """
    for _ in range(2):
        ends = links.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").filter("la <> lb").select("la", "lb")
        both = ends.unionByName(ends.select(F.col("lb").alias("la"), F.col("la").alias("lb")))
        hook = both.groupBy("la").agg(F.min("lb").alias("to")).select("la", F.least("la", "to").alias("to"))
        after = hook.toDF("to", "then")
        hook = cut_lineage(hook.join(after, "to", "left").select(F.col("la").alias("label"), F.coalesce("then", "to").alias("to")))
        labels = cut_lineage(labels.join(hook, "label", "left").select("sig", F.coalesce("to", "label").alias("label")))
    return labels


_NODE = ("sig", "label", "size", "pos", *_PARITY_COLUMNS)


def _pivot_pairs(entries: DataFrame, percent: int, round_no: int) -> DataFrame:
    """For each node the pivot it shares most prefix shingles with, among those of other components."""
    node = F.struct(*_NODE)
    # Two pivots a list: a member of the component with most nodes there, and a node of
    # another one, so that every node can meet one that is not of its own component.
    turn = F.xxhash64("sig", F.lit(round_no))
    held = entries.groupBy("h", "label").agg(F.count(F.lit(1)).alias("n"), F.min_by(node, turn).alias("node"))
    turn = F.xxhash64("label", F.lit(round_no))
    one = held.groupBy("h").agg(
        F.max_by("node", F.struct("n", turn)).alias("p"), F.min_by("node", F.struct("n", turn)).alias("q")
    ).filter("p.label <> q.label")
    met = entries.withColumn("x", node).join(one, "h").withColumn("y", F.when(F.col("label") == F.col("p.label"), F.col("q")).otherwise(F.col("p")))
    met = met.filter(_pass_filters(percent)).groupBy(F.col("x.sig").alias("s"), F.col("y.sig").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("s").agg(F.max_by("t", F.struct("n", "t")).alias("t"))
    return best.select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct()


def _other_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list whose components differ."""
    node = F.struct(*_NODE)
    mixed = entries.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("h")
    live = entries.join(mixed, "h", "left_semi").select("h", node.alias("x"))
    other = live.select("h", F.col("x").alias("y"))
    both = live.join(other, "h").filter("x.sig < y.sig and x.label <> y.label").filter(_pass_filters(percent))
    return both.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b")).distinct()


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``x`` with each of ``y``."""
    flat = np.concatenate([*x, *y])
    owner = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    column_of = np.cumsum(shared) - 1
    keep = shared[place]
    place, owner = column_of[place[keep]], owner[keep]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(x), len(y)), np.int64)
    n = int(shared.sum())
    bounds = np.searchsorted(place, np.arange(0, n + LINK_COLUMNS, LINK_COLUMNS))
    for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
        held = np.zeros((len(x) + len(y), min(LINK_COLUMNS, n - k * LINK_COLUMNS)), np.float32)
        held[owner[lo:hi], place[lo:hi] - k * LINK_COLUMNS] = 1
        out += (held[: len(x)] @ held[len(x) :].T).astype(np.int64)  # below 2 ** 24, so exact
    return out


_PAIR = ("root", "la", "ba", "lb", "bb")


def _links_in_components(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """sig, n: rows of other nodes linked with each of ``nodes`` (sig, root, size, copies).

    Nodes of similar sets have levels of size that differ by one at most.  A block is a
    part of a level; pairs of blocks of equal or neighbouring levels are compared.
    """
    base = float(np.log(1.0001 * 100 / percent))
    nodes = cut_lineage(nodes.withColumn("level", F.floor(F.log("size") / base)))
    large = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("total"))
    large = large.filter((F.col("m") > LINK_NODES) | (F.col("total") > LINK_SHINGLES)).select("root")
    total = nodes.agg(F.sum("size")).first()[0] or 0
    tasks = max(1, int(total) // LINK_SHINGLES)
    level = nodes.join(F.broadcast(large), "root", "left_semi").groupBy("root", "level").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / LINK_NODES, F.sum("size") / LINK_SHINGLES)).cast("int").alias("parts"))
    level = cut_lineage(level)
    beside = {k: level.select("root", (F.col("level") + k).alias("level"), F.col("parts").alias(name)) for k, name in ((-1, "above"), (1, "below"))}
    level = level.join(beside[-1], ["root", "level"], "left").join(beside[1], ["root", "level"], "left")
    dealt = nodes.join(F.broadcast(level), ["root", "level"], "left").withColumn("own", F.pmod(F.xxhash64("sig"), F.coalesce("parts", F.lit(1))).cast("int"))

    def pairs(count: str, make) -> Column:
        n = F.coalesce(F.col(count), F.lit(0))
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), make)).otherwise(F.array().cast(_PAIR_TYPE))

    def pair(la, ba, lb, bb, side) -> Column:
        return F.struct(la.alias("la"), ba.cast("int").alias("ba"), lb.alias("lb"), bb.cast("int").alias("bb"), side.cast("int").alias("side"))

    at, own = F.col("level"), F.col("own")
    split = F.concat(
        pairs("parts", lambda k: pair(at, F.least(own, k), at, F.greatest(own, k), own > k)),
        pairs("above", lambda k: pair(at, own, at + 1, k, F.lit(0))),
        pairs("below", lambda k: pair(at - 1, k, at, own, F.lit(1))),
    )
    whole = F.array(pair(F.lit(0).cast("long"), F.lit(0), F.lit(0).cast("long"), F.lit(0), F.lit(0)))
    dealt = dealt.withColumn("pair", F.explode(F.when(F.col("parts").isNull(), whole).otherwise(split)))
    dealt = dealt.select(
        F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("root"), F.lit(tasks))).otherwise(F.xxhash64("root", "pair.la", "pair.ba", "pair.lb", "pair.bb")).alias("task"),
        "root", "pair.*", "sig", "copies").join(sets, "sig")

    def count(rows: pa.Table) -> pa.Table:
        sig, copies, side = (rows.column(c).to_numpy() for c in ("sig", "copies", "side"))
        found = np.zeros(len(sig), np.int64)
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(rows.column(c).to_pylist() for c in _PAIR))):
            groups.setdefault(key, []).append(i)
        blobs = rows.column("shingles")
        for key, members in groups.items():
            mine = [i for i in members if side[i] == 0]
            same = key[1:3] == key[3:5]
            other = mine if same else [i for i in members if side[i] == 1]
            if not mine or not other:
                continue
            x = [_unpack(blobs[i].as_py()) for i in mine]
            y = x if same else [_unpack(blobs[i].as_py()) for i in other]
            both = _intersections(x, y)
            sizes = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :]
            linked = 100 * both >= percent * (sizes - both)
            if same:
                np.fill_diagonal(linked, False)
            found[mine] += linked @ copies[other]
            if not same:
                found[other] += linked.T @ copies[mine]
        return pa.table({"sig": rows.column("sig"), "n": pa.array(found, pa.int64())})

    counted = dealt.groupBy("task").applyInArrow(count, "sig long, n long")
    return counted.groupBy("sig").agg(F.sum("n").alias("n"))


_PAIR_TYPE = "array<struct<la: bigint, ba: int, lb: bigint, bb: int, side: int>>"


def _grouped(docs: DataFrame, width: int, percent: int, rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (kind 0 of :func:`_describe`), sig and root of the linked nodes, sig and shingles of the sets."""
    rows, folder = stored_at(_describe(docs, width, percent), "kind")
    # A list counts if two different nodes are in it: the ends of its numbers tell, summed up in the map tasks.
    held = rows.filter("kind = 1").groupBy("h").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo <> hi").select("h")
    entries = rows.filter("kind = 1").select("h", "sig", "size", "pos", *_PARITY_COLUMNS).join(held, "h", "left_semi")
    # Blocks may describe copies of one node each; one description is kept, and written once.
    entries = stored(entries.dropDuplicates(["sig", "pos"]))
    met = entries.select("sig").distinct()
    sets = stored(rows.filter("kind = 2").select("sig", "shingles").join(met, "sig", "left_semi")
                  .groupBy("sig").agg(F.first("shingles").alias("shingles")))
    for kind in (1, 2):
        discard(docs.sparkSession, f"{folder}/kind={kind}")
    labels = cut_lineage(entries.select("sig").distinct().withColumn("label", F.col("sig")))
    links = checked = None
    for r in range(rounds + 1):
        if links is not None:
            labels = _merge(labels, links)
        labelled = entries.join(labels, "sig")
        pairs = _pivot_pairs(labelled, percent, r) if r < rounds else _other_pairs(labelled, percent)
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        now = cut_lineage(_verify(pairs, sets, percent))
        checked = now if checked is None else checked.unionByName(now)
        links = checked.filter("linked").select("a", "b")
    roots = components(links).select(F.col("node").alias("sig"), "root")
    return rows.filter("kind = 0"), roots, sets


def similar_components(docs: DataFrame, width: int = 4, percent: int = 85, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of ``docs`` (doc_id, text).

    ``n_links`` is the number of other rows whose sets reach the threshold with the row's,
    copies included.
    """
    rows, roots, sets = _grouped(docs, width, percent, rounds)
    members = rows.select("doc_id", "sig", F.col("size").cast("long").alias("n_shingles"))
    nodes = members.filter("sig is not null").groupBy("sig").agg(
        F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("size"))
    nodes = cut_lineage(nodes.join(roots, "sig", "left"))
    linked = _links_in_components(nodes.filter("root is not null").select("sig", "root", "size", "copies"), sets, percent)
    nodes = nodes.withColumn("root", F.coalesce("root", "sig"))
    low = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.join(low, "root").join(linked, "sig", "left").select(
        "sig", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return members.join(named, "sig", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component stays.

    That is the one with the smallest id, and of several texts under it the one with the
    smallest digest.  Rows that repeat an id and a text are one; rows without an id stay.
    """
    rows, roots, _ = _grouped(docs, width, percent, ROUNDS)
    one = F.struct("doc_id", "digest")
    held = rows.filter("doc_id is not null").groupBy("doc_id", "digest", "sig").agg(F.count(F.lit(1)).alias("n"))
    held = cut_lineage(held.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig")).withColumn("one", one))
    first = held.filter("root is not null").groupBy("root").agg(F.min("one").alias("first"))
    gone = held.join(first, "root").filter("one <> first").select("doc_id", "digest")
    left = _without(docs, cut_lineage(gone), "left_anti")
    twice = cut_lineage(held.filter("n > 1").select("doc_id", "digest"))
    if twice.isEmpty():
        return left
    repeated = _without(left, twice, "left_semi").dropDuplicates(["doc_id", "text"])
    return _without(left, twice, "left_anti").unionByName(repeated).select(*docs.columns)


def _without(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` by a semi or anti-join with (doc_id, digest)."""
    keys = keys.toDF("__id", "__digest")
    same = (docs["doc_id"] == keys["__id"]) & (F.xxhash64(docs["text"]) == keys["__digest"])
    return docs.join(keys, same, how).select(*docs.columns)
