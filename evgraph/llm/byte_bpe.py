"""Byte-level BPE of whole texts, one tokenizer call per slice.

A text is cut before every space that stands between two characters which are no
white space; the pre-tokenizer always cuts there, so the parts encode alone as they do
in the text.  Distinct parts of a slice are encoded once and their ids are gathered
for every occurrence.  Texts with other white space next to a space are encoded whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evgraph.llm.common import spread, vocabulary

#: Public pre-tokenizer pattern of this vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT = "byte_bpe_50k.json"


def _byte_of_letter() -> dict[str, int]:
    """The vocabulary writes bytes as letters: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder for a vocabulary file of the tokenizers library; special strings are plain text."""

    _loaded: dict[str, ByteBpe] = {}

    def __init__(self, name: str = DEFAULT):
        import tiktoken

        with open(vocabulary(name), encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec.get("added_tokens", ())}
        letters = _byte_of_letter()
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(w) for w in ranks]

    @classmethod
    def load(cls, name: str = DEFAULT) -> ByteBpe:
        """One encoder per worker process."""
        if name not in cls._loaded:
            cls._loaded[name] = cls(name)
        return cls._loaded[name]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.asarray(self.encoding.encode_ordinary(t), np.uint32) for t in texts]
        lengths = np.array([len(p) for p in parts], np.int64)
        return np.concatenate([np.zeros(0, np.uint32), *parts]), lengths

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of `` word`` for words without white space at their ends, encoded in one call."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = np.asarray(self.encoding.encode_to_numpy(" " + " ".join(words), disallowed_special=()), np.uint32)
        begins = np.cumsum(self.size[ids]) - self.size[ids]
        sizes = np.array([len(w.encode()) + 1 for w in words], np.int64)
        first = np.searchsorted(begins, np.cumsum(sizes) - sizes)
        return ids, np.diff(np.append(first, len(ids)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        parts = pc.split_pattern(texts, " ")
        at = np.asarray(parts.offsets, np.int64)
        at = at - at[0]
        coded = parts.flatten().dictionary_encode()
        codes = np.asarray(coded.indices, np.int64)
        words = coded.dictionary.to_pylist()
        odd = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words], bool)
        whole = np.add.reduceat(odd[codes].astype(np.int64), at[:-1]) > 0
        good = np.flatnonzero(~odd)
        pool, size = self._words([words[i] for i in good])
        lengths = np.zeros(len(words), np.int64)
        lengths[good] = size
        starts = np.zeros(len(words), np.int64)
        starts[good] = np.cumsum(size) - size

        # The first part of a text has no space before it; it is kept as an entry of its own.
        heads, head_of = np.unique(codes[at[:-1]], return_inverse=True)
        head_ids, head_sizes = self._whole([words[i] for i in heads])
        whole_ids, whole_sizes = self._whole([texts[int(i)].as_py() for i in np.flatnonzero(whole)])
        base = len(pool)
        pool = np.concatenate([pool, head_ids, whole_ids])
        use_start, use_length = starts[codes], lengths[codes]
        use_length[np.repeat(whole, np.diff(at))] = 0
        use_start[at[:-1]] = base + (np.cumsum(head_sizes) - head_sizes)[head_of]
        use_length[at[:-1]] = head_sizes[head_of]
        first = at[:-1][whole]
        use_start[first] = base + len(head_ids) + np.cumsum(whole_sizes) - whole_sizes
        use_length[first] = whole_sizes
        return pool[spread(use_start, use_length)], np.add.reduceat(use_length, at[:-1])
