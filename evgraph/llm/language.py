"""Language identification by compression with per-language dictionaries.

A model holds, for each language, raw content of a bounded sample of its texts.  A text
is reduced to lower-case letters and spaces, cut into chunks and compressed with every
dictionary; the language with the fewest bytes wins.  A chunk is measured as the growth
of a frame that starts with text of the dictionary, so that also a single word is
compressed rather than stored.  Where the two best sizes are close, the text is measured
behind more leads of the dictionaries and the mean decides, which tells apart sizes that
differ by less than a byte.  Equal sizes go to the language seen more often.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected;
a text of any length whose best and second size are equal or differ by less than
``NARROW`` is rejected;
without labelled rows every text is ``und``; with one language the score is 1; rows that
repeat get the same answer; other columns are not carried.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import column, slices
from evgraph.operators.ordered import top_per_key

#: Bound of the training sample: texts per language, and bytes of each that enter a dictionary.
SAMPLE_TEXTS = 256
SAMPLE_BYTES = 400
LEVEL = 9
CHUNK = 4096
#: Relative difference of the two smallest sizes below which a text is rejected.
NARROW = 0.01
#: Relative difference, or difference in bytes, below which a text is measured behind this many more leads.
CLOSE, CLOSE_BYTES, LEADS = 0.015, 2, 12
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower-case letters in UTF-8; runs of other ASCII signs are one space."""
    return b" ".join(text.lower().encode().translate(_KEEP).split())


@dataclass
class Model:
    """Dictionary content and number of training texts per language."""

    content: dict[str, bytes]
    seen: dict[str, int]
    level: int = LEVEL
    _ready: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_ready": []}

    def _coders(self):
        if not self._ready:
            for lang in sorted(self.content, key=lambda x: (-self.seen[x], x)):
                raw = self.content[lang]
                words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=self.level)
                coder = zstandard.ZstdCompressor(dict_data=words, level=self.level, write_content_size=False,
                                                 write_checksum=False, write_dict_id=False)
                leads = [raw[len(raw) * (k + 1) // (LEADS + 8) :][:160] + b" " for k in range(LEADS + 1)]
                self._ready.append((lang, coder, [(lead, len(coder.compress(lead))) for lead in leads]))
        return self._ready

    def sizes(self, text: str, first: int = 0, last: int = 1) -> list[tuple[float, str]]:
        """(mean bytes behind these leads, language) in the order of preference at equal sizes."""
        raw = normal(text)
        chunks = [raw[k : k + CHUNK] for k in range(0, max(1, len(raw)), CHUNK)]
        out = []
        for lang, coder, leads in self._coders():
            total = sum(len(coder.compress(lead + c)) - base for lead, base in leads[first:last] for c in chunks)
            out.append((total / (last - first), lang))
        return out

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether the text is rejected."""
        if not self.content or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        ordered = sorted(self.sizes(text), key=lambda x: x[0])  # stable: ties keep the order of preference
        if len(ordered) == 1:
            return ordered[0][1], 1.0, False
        if ordered[1][0] - ordered[0][0] < max(CLOSE_BYTES, CLOSE * ordered[1][0]):
            ordered = sorted(self.sizes(text, 1, LEADS + 1), key=lambda x: x[0])
        best, apart = ordered[0][0], ordered[1][0] - ordered[0][0]
        weights = [math.exp(-min(700.0, (size - best) * math.log(2))) for size, _ in ordered]
        return ordered[0][1], 1.0 / sum(weights), apart <= 0 or apart < NARROW * ordered[1][0]


def held_out(doc_id: Column) -> Column:
    """Rows that never take part in learning: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def learn(labelled: DataFrame, texts: int = SAMPLE_TEXTS, size: int = SAMPLE_BYTES) -> Model:
    """Model from rows (text, lang): a bounded sample of different texts per language.

    Texts are ordered by hash; a text of many copies counts once.  Texts of at least
    ``size`` characters come first.  The driver gets at most ``texts`` short strings per
    language.
    """
    rows = labelled.filter("text is not null and lang is not null")
    keyed = rows.select("lang", F.xxhash64("text").alias("h"), (F.length("text") < size).alias("short"))
    seen = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = top_per_key(keyed.distinct(), ["lang"], [F.col("short"), F.col("h")], texts).select("lang", "h")
    sample = (
        rows.select("lang", F.xxhash64("text").alias("h"), F.col("text").substr(1, 2 * size).alias("part"))
        .join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("part").alias("part")).orderBy("lang", "h")
    )
    parts: dict[str, list[bytes]] = {}
    for r in sample.collect():
        parts.setdefault(r["lang"], []).append(normal(r["part"])[:size])
    return Model({k: b" ".join(v) for k, v in parts.items()}, seen)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with lang_pred, score and rejected of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    picked = docs.select(*keep, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batches, "__text"):
            found = [known.predict(t) for t in column(part, "__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(len(keep))), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                [*keep, "lang_pred", "score", "rejected"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, lang_pred string, score double, rejected boolean")


def keep_recognised(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in slices(batches, text):
            texts = pc.fill_null(part.column(place), "").to_pylist()
            yield part.filter(pa.array([not known.predict(t)[2] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learned_on(docs: DataFrame) -> Model:
    """Model from the documents that are not held out."""
    return learn(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
