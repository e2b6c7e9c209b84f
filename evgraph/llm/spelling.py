"""Spelling variants: words one edit apart, found by pivotal bigrams.

Words are counted in the map tasks.  All bigrams of the words get one order, rare ones first.  A word's
gram prefix is its ``2 * EDITS + 1`` rarest bigrams with all ties of the last one; its pivots are
``EDITS + 1`` bigrams of the prefix that do not overlap and are rarest together, chosen by dynamic
programming.  One edit cannot break both pivots, so of two near words the one whose prefix ends
earlier has a pivot that the other's prefix holds.  Its place is limited too: either the edit comes
after the gram, and all letters up to the gram are the same, or it comes before, and all letters from
the gram on are the same.  Pivots therefore meet prefixes by gram, side, place, checksum of the same
side and length; parities of letters thin out what meets, and each pair left is verified once.

Only numbers travel with grams; words are joined to the pairs at the end.  The order of bigrams is the
one thing each task gets whole: 90 letters make 8,100 bigrams at most.

Defined cases: a null text has no words, a null id reads as the empty text; rows that repeat count each;
a word of any length is one word; among near words with equal counts the smallest in code-point order is
the form; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import column, slices, stored, utf8
from evgraph.session import cut_lineage

EDITS = 1
#: Smallest words, by code points and by occurrences.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form occurs so many times as often as its variant, at least.
LEAD = 2
#: One in so many (document, word) pairs loses a letter: the typing noise of the registered query.
NOISE = 97
#: Distinct words a task holds before it hands its counts on, and bytes of a text cut at once.
HELD, PIECE = 200_000, 4 << 20


def _letters(data: np.ndarray) -> bytes:
    """Bytes with A-Z lower-cased and everything but a-z and U+00C0..U+00FF blank."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    lead = data == 0xC3
    keep = ((low >= 97) & (low <= 122)) | lead
    keep[1:] |= lead[:-1]
    return np.where(keep, low, 32).astype(np.uint8).tobytes()


def _pieces(raw: bytes, start: int, end: int) -> Iterator[list[bytes]]:
    """Words of a document, some million bytes at a time, never cutting one."""
    while start < end:
        stop = end if end - start <= PIECE else raw.find(b" ", start + PIECE, end)
        stop = end if stop < 0 else stop
        yield raw[start:stop].split()
        start = stop


def word_counts(docs: DataFrame, text: str = "text", noise: int | None = None) -> DataFrame:
    """word, n: words of at least ``LEAST_LENGTH`` letters with ``LEAST_COUNT`` occurrences.

    With ``noise`` a word loses a letter wherever the checksum of ``<doc_id>:<word>`` is divisible by it.
    """

    def damaged(id_: bytes, words: list[bytes], total: Counter) -> None:
        base = zlib.crc32(id_ + b":")
        crc = zlib.crc32
        own = Counter(words)
        for w in [w for w in own if crc(w, base) % noise == 0]:
            n = own[w]
            total[w] -= n
            letters = w.decode()
            cut = crc(w, base) % len(letters)
            total[(letters[:cut] + letters[cut + 1 :]).encode()] += n

    def handed(total: Counter) -> pa.RecordBatch:
        # Two bytes a letter from U+00C0 on, all with the same first one.
        kept = [(w, n) for w, n in total.items() if n and len(w) - w.count(b"\xc3") >= LEAST_LENGTH]
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for part in slices(batches, "__text"):
            data, at = utf8(column(part, "__text"))
            raw, ends = _letters(data), at.tolist()
            for id_, a, b in zip(column(part, "__id").to_pylist(), ends, ends[1:]):
                for words in _pieces(raw, a, b):
                    total.update(words)
                    if noise:
                        damaged(id_.encode(), words, total)
                    if len(total) > HELD:
                        yield handed(total)
                        total = Counter()
        yield handed(total)

    rows = docs.select(F.col("doc_id").cast("string").alias("__id"), F.col(text).alias("__text"))
    found = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= LEAST_COUNT)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Place in the order and number of words of every bigram; 8,100 bigrams at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                total.update(map(str.__add__, w, w[1:]))
        yield pa.RecordBatch.from_pydict({"gram": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    found = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    ordered = sorted((r["n"], r["gram"]) for r in found)
    return {gram: (i, n) for i, (n, gram) in enumerate(ordered)}


def pivots(places: list[int], cost: list[int], wanted: int = EDITS + 1) -> list[int]:
    """The ``wanted`` cheapest places of bigrams that share no letter; ``places`` ascend.

    ``best[k][j]`` is the least cost of k bigrams among the first j places: without the last of them,
    or with it and k - 1 bigrams that end before it starts.
    """
    far = float("inf")
    before, free = [], 0
    for p in places:
        while places[free] <= p - 2:
            free += 1
        before.append(free)
    best = [[0.0] * (len(places) + 1)]
    for _ in range(wanted):
        row = [far]
        for j, c in enumerate(cost):
            row.append(min(row[j], best[-1][before[j]] + c))
        best.append(row)
    chosen, j = [], len(places)
    for k in range(wanted, 0, -1):
        while best[k][j] == best[k][j - 1]:
            j -= 1
        chosen.append(places[j - 1])
        j = before[j - 1]
    return chosen[::-1]


def _sides(word: str, places: list[int]) -> list[tuple[int, int]]:
    """For each place the checksums of the word up to its bigram's end and from its start on, one pass each."""
    left, right, total = {}, {}, len(word)
    raw = word.encode("utf-16-le")
    crc, at = 0, 0
    for p in places:
        crc, at = zlib.crc32(raw[2 * at : 2 * p + 4], crc), p + 2
        left[p] = crc
    raw = word[::-1].encode("utf-16-le")
    crc, at = 0, 0
    for p in reversed(places):
        crc, at = zlib.crc32(raw[2 * at : 2 * (total - p)], crc), total - p
        right[p] = crc
    return [(left[p], right[p]) for p in places]


def _parity(word: str) -> int:
    """One bit per letter (mod 64) that occurs an odd number of times; one edit changes two bits at most."""
    bits = 0
    for c in word:
        bits ^= 1 << (ord(c) & 63)
    return bits - (1 << 64) if bits >> 63 else bits


def gram_index(words: DataFrame, order: dict[str, tuple[int, int]]) -> DataFrame:
    """id, length, parity, last, pivot, key: two rows (sides) per bigram of each word's prefix.

    ``last`` is the place in the order where the prefix ends; ``pivot`` marks the chosen bigrams;
    ``key`` holds bigram, side and the checksum of that side.
    """
    handed = words.sparkSession.sparkContext.broadcast(order)
    size = 2 * EDITS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_of = handed.value
        for part in slices(batches, "word", 1 << 19):
            out: list[tuple] = []
            for id_, w in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = [place_of[w[i : i + 2]] for i in range(len(w) - 1)]
                last = sorted(found)[size - 1][0]
                places = [i for i, (o, _) in enumerate(found) if o <= last]
                chosen = set(pivots(places, [found[i][1] for i in places]))
                parity = _parity(w)
                for p, (a, b) in zip(places, _sides(w, places)):
                    gram = found[p][0] * 2
                    out.append((id_, len(w), parity, last, p in chosen, (a << 31) | gram))
                    out.append((id_, len(w), parity, last, p in chosen, (b << 31) | gram | 1))
            cols = list(zip(*out))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["id", "length", "parity", "last", "pivot", "key"])

    return words.select("id", "word").mapInArrow(run, "id long, length int, parity long, last int, pivot boolean, key long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, word_a, word_b, n_a, n_b: every pair of words one edit apart, once; ``words`` has id, word, n."""
    index = stored(gram_index(words, gram_order(words)))  # read twice
    lengths = F.explode(F.array(*[F.col("length") + d for d in range(-EDITS, EDITS + 1)]))
    p = index.filter("pivot").select(F.col("id").alias("a"), F.col("parity").alias("pa"), F.col("last").alias("la"), "key", lengths.alias("length"))
    r = index.select(F.col("id").alias("b"), F.col("parity").alias("pb"), F.col("last").alias("lb"), "key", "length")
    met = p.join(r, ["key", "length"]).filter(
        (F.col("a") != F.col("b")) & (F.col("la") <= F.col("lb"))
        & (F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= 2 * EDITS))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in ("a", "b"):
        side = words.select(F.col("id").alias(end), F.col("word").alias(f"word_{end}"), F.col("n").alias(f"n_{end}"))
        pairs = pairs.join(side, end)
    return pairs.filter(F.levenshtein("word_a", "word_b", EDITS) == EDITS)


def _roots(links: DataFrame) -> DataFrame:
    """word, root: the last form that ``links`` (word, form) lead to.

    A form is ``LEAD`` times as frequent as its word, so links never go round; paths double each round.
    """
    found = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        found = cut_lineage(found.join(onward, "root", "left").select(
            "word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")))
        if found.filter("moved").isEmpty():
            return found.select("word", "root")
        found = found.select("word", "root")


def variant_groups(counts: DataFrame, lead: Column | float = LEAD) -> DataFrame:
    """word, form, root, n, n_near, form_n for words with their counts (word, n)."""
    words = stored(counts.select("word", "n", F.monotonically_increasing_id().alias("id")))
    pairs = near_pairs(words)
    ways = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.col("word_b").alias("near"), F.col("n_b").alias("m")),
        F.struct(F.col("b").alias("id"), F.col("word_a").alias("near"), F.col("n_a").alias("m")))).alias("w")).select("w.*")
    best = ways.groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    form_n = -F.col("best.m")
    enough = form_n >= F.col("n") * lead
    found = stored(words.join(best, "id", "left").select(
        "word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, form_n).alias("form_n")))
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
