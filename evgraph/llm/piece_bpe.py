"""SentencePiece BPE by merge rounds over flat arrays.

Spaces become U+2581 and one is put in front.  No piece has that sign after another
letter, so merges never cross the place where a word starts.  The distinct words of a
slice lie in one flat array of symbols.  In a round each word finds the smallest rank
among its neighbouring pairs (a segmented minimum) and merges that pair, leftmost first
and wherever it occurs in the word; the array is compacted and finished words leave it.
If a merge would give rise to a pair of smaller rank, which must come first, the word
merges only the leftmost occurrence in that round.  Pairs of equal rank are taken from
the left, one per round.

Defined cases: null is the empty text, whose ids are begin and end only; letters outside
the vocabulary become byte pieces; special pieces written out in a text are plain text;
rows that repeat give equal rows; other columns are not carried.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evgraph.llm.common import column, mix, slices, spread, vocabulary

DEFAULT = "piece_bpe_32k.model"
SPACE = "▁"
_NO_PAIR = np.int64(1 << 40)
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


def _bad_bytes(error: UnicodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error("evgraph_each_byte", _bad_bytes)


class PieceBpe:
    """Pieces and pair ranks of a model file."""

    _loaded: dict[str, PieceBpe] = {}

    def __init__(self, name: str = DEFAULT):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        n = model.get_piece_size()
        pieces = model.id_to_piece(list(range(n)))
        self.bos, self.eos = model.bos_id(), model.eos_id()
        is_byte = [model.is_byte(i) for i in range(n)]
        plain = [i for i in range(n) if not (is_byte[i] or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self._surfaces(pieces, is_byte, set(plain))

        symbol = {pieces[i]: i for i in plain}
        for letter in sorted({c for i in plain for c in pieces[i]} - set(symbol)):
            symbol[letter] = n + len(symbol)  # only ever part of a piece
        self.letter = np.full(0x110000, -1, np.int32)
        for piece, i in symbol.items():
            if len(piece) == 1:
                self.letter[ord(piece)] = i
        scores = {i: model.get_score(i) for i in plain}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        often = {s: 0 for s in order}
        for s in scores.values():
            often[s] += 1
        pairs = {}
        for i in plain:
            p = pieces[i]
            for cut in range(1, len(p)):
                if p[:cut] in symbol and p[cut:] in symbol:
                    pairs[(symbol[p[:cut]] << 32) | symbol[p[cut:]]] = (order[scores[i]], i)
        self.tied = np.zeros(len(order) + 1, bool)
        for s, r in order.items():
            self.tied[r] = often[s] > 1
        self._table(pairs)

    @classmethod
    def load(cls, name: str = DEFAULT) -> PieceBpe:
        """One model per worker process."""
        if name not in cls._loaded:
            cls._loaded[name] = cls(name)
        return cls._loaded[name]

    def _surfaces(self, pieces: list[str], is_byte: list[bool], plain: set[int]) -> None:
        raw = []
        for i, p in enumerate(pieces):
            if is_byte[i]:
                raw.append(bytes([int(p[3:5], 16)]))
            else:
                raw.append(p.replace(SPACE, " ").encode() if i in plain else b"")
        self.surface = np.frombuffer(b"".join(raw), np.uint8)
        self.surface_size = np.array([len(r) for r in raw], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size

    def _table(self, pairs: dict[int, tuple[int, int]]) -> None:
        """Open addressing with linear probing over four times as many slots."""
        self._shift = np.uint64(64 - max(4, (4 * len(pairs)).bit_length()))
        size = 1 << (64 - int(self._shift))
        self._key = np.full(size, -1, np.int64)
        self._rank = np.full(size, _NO_PAIR, np.int64)
        self._merged = np.full(size, -1, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        slots = (mix(keys.view(np.uint64)) >> self._shift).astype(np.int64)
        for key, slot in zip(keys.tolist(), slots.tolist()):
            while self._key[slot] != -1:
                slot = (slot + 1) % size
            self._key[slot] = key
            self._rank[slot], self._merged[slot] = pairs[key]

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; ``_NO_PAIR`` where there is none."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        slot = (mix(key.view(np.uint64)) >> self._shift).astype(np.int64)
        got = self._key[slot]
        again = np.flatnonzero((got != key) & (got != -1))
        while len(again):
            slot[again] = (slot[again] + 1) % len(self._key)
            got = self._key[slot[again]]
            again = again[(got != key[again]) & (got != -1)]
        hit = self._key[slot] == key
        return np.where(hit, self._rank[slot], _NO_PAIR), self._merged[slot]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        sym, word = self.letter[points], np.repeat(np.arange(len(words)), sizes)
        src = np.arange(len(points))
        rank = np.full(len(sym), _NO_PAIR, np.int64)
        merged = np.full(len(sym), -1, np.int32)
        inside = np.flatnonzero((word[1:] == word[:-1]) & (sym[1:] >= 0) & (sym[:-1] >= 0))
        rank[inside], merged[inside] = self._find(sym[inside], sym[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            count = np.diff(np.append(starts, len(sym)))
            over = np.repeat(low == _NO_PAIR, count)
            if over.any():
                done.append((word[over], sym[over], src[over]))
                keep = ~over
                sym, word, src, rank, merged = sym[keep], word[keep], src[keep], rank[keep], merged[keep]
                if not len(sym):
                    break
                live = low != _NO_PAIR
                low, count = low[live], count[live]
            at = np.flatnonzero(rank == np.repeat(low, count))
            at = self._take(at, sym, word, rank, merged)
            sym[at] = merged[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            keep = ~gone
            sym, word, src, rank, merged, touched = (a[keep] for a in (sym, word, src, rank, merged, touched))
            new = np.flatnonzero(touched)
            before = new[new > 0] - 1
            fresh = np.unique(np.concatenate([before, new]))
            fresh = fresh[fresh < len(sym) - 1]
            same = (word[fresh] == word[fresh + 1]) & (sym[fresh] >= 0) & (sym[fresh + 1] >= 0)
            rank[new] = _NO_PAIR
            fresh = fresh[same]
            rank[fresh], merged[fresh] = self._find(sym[fresh], sym[fresh + 1])
        return self._assemble(done, points, len(words))

    def _take(self, at, sym, word, rank, merged):
        """Occurrences to merge at once, from the left, without overlap, or the first of a word."""
        if not len(at):
            return at
        first = np.r_[True, word[at[1:]] != word[at[:-1]]]
        if first.all():
            return at
        # Every other place of a row of neighbouring places, counted from its first.
        row = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | first[1:]])
        place = np.arange(len(at)) - np.repeat(row, np.diff(np.append(row, len(at))))
        chosen = place % 2 == 0
        pick, lead = at[chosen], first[chosen]
        # A pair that a merge newly forms must not come before the others of its word.
        new, low = merged[pick], rank[pick]
        right = np.minimum(pick + 2, len(sym) - 1)
        ok = (pick + 2 < len(sym)) & (word[right] == word[pick])
        bad = ok & (self._find(new, sym[right])[0] < low) & (sym[right] >= 0)
        left = np.maximum(pick - 1, 0)
        behind = np.r_[False, pick[1:] == pick[:-1] + 2]  # its left neighbour was merged just before
        symbol = np.where(behind, np.r_[np.int32(-1), new[:-1]], sym[left])
        ok = (pick > 0) & (word[left] == word[pick]) & (symbol >= 0)
        bad |= ok & (self._find(symbol, new)[0] < low)
        bad |= self.tied[low]
        spoilt = np.zeros(int(word[-1]) + 1, bool)
        spoilt[word[pick[bad]]] = True
        return pick[lead | ~spoilt[word[pick]]]

    def _assemble(self, done, points, n):
        word = np.concatenate([d[0] for d in done])
        sym = np.concatenate([d[1] for d in done])
        src = np.concatenate([d[2] for d in done])
        order = np.argsort(src)
        word, sym, src = word[order], sym[order], src[order]
        alien = np.flatnonzero((sym < 0) | (sym >= len(self.surface_size)))
        if not len(alien):
            return sym, np.bincount(word, minlength=n)
        raw = [chr(int(points[s])).encode() for s in src[alien]]
        width = np.ones(len(sym), np.int64)
        width[alien] = [len(r) for r in raw]
        out, word = np.repeat(sym, width), np.repeat(word, width)
        starts = np.cumsum(width) - width
        out[spread(starts[alien], width[alien])] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.bincount(word, minlength=n)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end, one text after the other, and how many each has."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        parts = pc.split_pattern(texts, " ")
        at = np.asarray(parts.offsets, np.int64)
        at = at - at[0]
        coded = parts.flatten().dictionary_encode()
        codes = np.asarray(coded.indices, np.int64)
        known = coded.dictionary.to_pylist()
        odd = np.array([not w or SPACE in w for w in known], bool)
        words = [SPACE + w for w in known]
        # Texts with empty parts (repeated spaces, spaces at an end) are cut by the rule itself.
        whole = np.add.reduceat(odd[codes].astype(np.int64), at[:-1]) > 0
        number: dict[str, int] = {}
        rows: list[np.ndarray] = []
        last = 0
        for i in np.flatnonzero(whole).tolist():
            text = texts[i].as_py()
            found = _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []
            rows.append(codes[at[last] : at[i]])
            rows.append(np.array([number.setdefault(w, len(words) + len(number)) for w in found], np.int64))
            last = i + 1
        rows.append(codes[at[last] : at[-1]])
        counts = np.diff(at)
        counts[whole] = [len(r) for r in rows[1::2]]
        ids, sizes = self.encode_words([*words, *number])
        starts = np.cumsum(sizes) - sizes
        used = np.concatenate(rows)
        body = ids[spread(starts[used], sizes[used])]
        ends = np.concatenate([[0], np.cumsum(sizes[used])])
        doc_end = ends[np.cumsum(counts)]
        length = np.diff(np.concatenate([[0], doc_end]))
        out = np.empty(len(body) + 2 * len(texts), np.int32)
        place = np.cumsum(length + 2) - (length + 2)
        frame = np.zeros(len(out), bool)
        frame[place] = frame[place + length + 1] = True
        out[~frame] = body
        out[place], out[place + length + 1] = self.bos, self.eos
        return out, length + 2

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Text of each id list in UTF-8; the space put in front is taken away again."""
        raw = self.surface[spread(self.surface_start[ids], self.surface_size[ids])].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.surface_size[ids])])[np.concatenate([[0], np.cumsum(sizes)])]
        texts = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            text = raw[a + 1 : b] if raw[a : a + 1] == b" " and b > a else raw[a:b]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = text.decode(errors="evgraph_each_byte").encode()
            texts.append(text)
        return texts


def encode_documents(docs: DataFrame, text: str = "text", vocabulary: str = DEFAULT) -> DataFrame:
    """doc_id, ids (array of int), decoded of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBpe.load(vocabulary)
        for part in slices(batches, "__text"):
            ids, sizes = bpe.encode(column(part, "__text"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)),
                 pa.array([t.decode() for t in bpe.decode(ids, sizes)], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("__text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, text: str = "text", vocabulary: str = DEFAULT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same work with digests instead of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PieceBpe.load(vocabulary)
        for part in slices(batches, "__text"):
            ids, sizes = bpe.encode(column(part, "__text"))
            view = memoryview(ids.astype("<u4")).cast("B")
            ends = (4 * np.cumsum(sizes)).tolist()
            digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip([0, *ends[:-1]], ends)]
            texts = [hashlib.sha256(t).hexdigest() for t in bpe.decode(ids, sizes)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("__text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
