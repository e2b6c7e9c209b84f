"""Secret scan: fixed patterns, and strings that a primed compressor finds new.

Candidates are the matches of three patterns and further long strings that stand close
behind a sensitive word.  Each is measured by the bytes it adds to a compressed frame of
its surroundings, with a dictionary of identifiers and of ordinary words around it.  A
candidate of the second sort is reported if it adds nearly as many bytes as it is long.
Every pattern match is reported, with the same measure beside it.

Defined cases: null is the empty text without spans; spans count code points, the end is
exclusive; a string that overlaps a reported pattern span is not reported again; rows
that repeat give equal rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import column, slices

#: Fixed patterns and least lengths of the base kinds.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make the text behind them sensitive, and how far that reaches.
SENSITIVE = re.compile(r"(?i:passw|passphrase|secret|token|api[_ -]?key|credential|private|bearer|authorization|access[_ -]?key)", re.ASCII)
REACH = 64
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
#: Length from which a value inside a candidate is looked for in the surroundings.
LEAST = 16
#: Bytes added per byte from which a candidate is new, and the surroundings it is measured in.
NOVELTY = 0.75
AROUND = 1024
LEVEL = 9

#: Identifiers and phrases common around credentials in code and configuration.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key client_secret private_key public_key authorization bearer "
    "credential username user login account config settings environment variable default example placeholder changeme "
    "your_token_here your_api_key xxxxxxxxxxxxxxxx 00000000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ localhost http://www.example.com https:// .json .yaml .properties import from return "
    "function class self this public static const string null true false None get_secret set_password getenv os.environ "
)


class Novelty:
    """Bytes that a string adds to its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = LEVEL):
        words = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.coder = zstandard.ZstdCompressor(dict_data=words, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        """Added compressed bytes per byte of ``text[start:end]``, given what stands around it.

        Other occurrences of the string, or of the value behind its last equals sign, are
        blanked first: a secret that is repeated is as new as one that stands alone.
        """
        own = text[start:end]
        value = own.rstrip("=").rpartition("=")[2]
        reach = AROUND + end - start
        low = max(0, start - reach)
        before, after = text[low:start], text[end : end + reach]
        for other in {own, value} if len(value) >= LEAST else {own}:
            before, after = (x.replace(other, "\n" * len(other)) for x in (before, after))
        around = (after[:AROUND] + "\n" + before[max(0, start - AROUND) - low :]).encode()
        inner = text[start:end].encode()
        return max(0.0, (len(self.coder.compress(around + inner)) - len(self.coder.compress(around))) / max(1, len(inner)))


def _odd(s: str) -> bool:
    """Digits, or both cases inside: words of prose have neither."""
    return any(c.isdigit() for c in s) or any(c.islower() for c in s) and any(c.isupper() for c in s[1:])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end, kind of the pattern matches that are long enough."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _merged(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts of spans in order, and how far the spans up to each of them reach."""
    starts, reach = [], []
    for a, b, _ in sorted(spans):
        starts.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    return starts, reach


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str, float]]:
    """Long strings behind sensitive words that no pattern took and that do not compress."""
    found, done = [], -1
    starts, reach = _merged(taken)
    for word in SENSITIVE.finditer(text):
        # A start is looked for within reach only; the match found there is then taken whole.
        at, last = word.end(), word.end() + REACH
        while (m := CANDIDATE.search(text, at, last + LEAST)) and m.start() <= last:
            m = CANDIDATE.match(text, m.start())
            at = m.end()
            if m.start() <= done:
                continue
            done = m.start()
            k = bisect_left(starts, m.end()) - 1
            if k >= 0 and reach[k] > m.start() or not _odd(m[0]):
                continue
            added = novelty(text, m.start(), m.end())
            if added >= NOVELTY:
                found.append((m.start(), m.end(), "novel", added))
    return found


def scan(text: str, novelty: Novelty) -> list[tuple[int, int, str, float]]:
    """Start, end, kind and novelty of all spans, by start and then by kind as listed."""
    base = base_spans(text)
    spans = [(a, b, k, novelty(text, a, b)) for a, b, k in base] + novel_spans(text, base, novelty)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame, text: str = "text", identifiers: str = IDENTIFIERS) -> DataFrame:
    """doc_id, spans: array of (start, end, kind, novelty) of every row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("novelty", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for part in slices(batches, "__text"):
            rows = [
                [dict(zip(("start", "end", "kind", "novelty"), s)) for s in scan(t, novelty)]
                for t in column(part, "__text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("__text")).mapInArrow(
        run, "doc_id long, spans array<struct<start: long, end: long, kind: string, novelty: double>>")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans as text, n_novel, novelty of :func:`find_secrets`."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        count("novel").alias("n_novel"), F.array_max(F.transform("spans", lambda s: s["novelty"])).alias("novelty"),
    )
