"""Encoding of whole texts with the tokenizers library, piece by piece.

Neither vocabulary merges across the start of a run of white space (``byte_bpe_50k``:
a run belongs to the word after it; ``word_bpe_49k``: white space is dropped), so the
ids of a text are those of its space-led words, one after the other; nor across a mark
such as ``.`` or ``%`` right after a letter of A-Z.  Each distinct word is encoded once
and remembered by its 64-bit hash; occurrences are filled in by index.
tests/llm compare this with encoding whole texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from .common import Words, buffers, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SLICE = 4 << 20
MOST_REMEMBERED = 3_000_000
_LOADED: dict[tuple[str, bool], "Encoder"] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Remembers the ids of each word by the word's hash; one for each vocabulary in a Python worker.

    path: the vocabulary file. lead: whether words carry the white space before them.
    lower: whether the vocabulary's own normalizer lower-cases, so that one case serves both.
    """

    def __init__(self, path: str, lead: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lead, self.lower = lead, not lead
        self.forget()

    @classmethod
    def load(cls, path: str, lead: bool) -> Encoder:
        if (path, lead) not in _LOADED:
            _LOADED[path, lead] = cls(path, lead)
        return _LOADED[path, lead]

    def forget(self) -> None:
        self.hash, self.at, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> None:
        """hashes: ascending, not yet known."""
        ids = [e.ids for k in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts[k : k + 4096]], add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(length.sum())
        if self.used + total > len(self.flat):
            self.flat = np.append(self.flat[: self.used], np.zeros(max(total, self.used), np.uint32))
        self.flat[self.used : self.used + total] = np.fromiter((x for e in ids for x in e), np.uint32, total)
        where = np.searchsorted(self.hash, hashes)
        self.hash = np.insert(self.hash, where, hashes)
        self.at = np.insert(self.at, where, self.used + np.cumsum(length) - length)
        self.length = np.insert(self.length, where, length)
        self.used += total

    @staticmethod
    def _keep_case(words: Words) -> None:
        """Special tokens are looked for before any lower-casing: words that may hold one keep their case."""
        raw = words.data
        opens = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        for w in np.unique(np.searchsorted(words.starts, opens, "right") - 1).tolist():
            text = raw[words.starts[w] : words.ends[w]].tobytes()
            words.hash[w] = int.from_bytes(blake2b(text, digest_size=8).digest(), "big")

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, and where each text's ids begin and the last ends."""
        words = Words(data, offsets, lead=self.lead, lower=self.lower, marks=True)
        n = len(offsets) - 1
        if not len(words.starts):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if self.lower:
            self._keep_case(words)
        hashes, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.hash) > MOST_REMEMBERED:
            self.forget()
        i = np.searchsorted(self.hash, hashes)
        new = np.flatnonzero(self.hash[np.minimum(i, len(self.hash) - 1)] != hashes) if len(self.hash) else np.arange(len(hashes))
        if len(new):
            raw = words.data.tobytes()
            self._learn(hashes[new], [raw[s:e] for s, e in zip(words.starts[first[new]].tolist(), words.ends[first[new]].tolist())])
            i = np.searchsorted(self.hash, hashes)
        each = self.length[i].astype(np.int64)[which]
        total = np.cumsum(each)
        out = self.flat[np.repeat(self.at[i][which] - (total - each), each) + np.arange(int(total[-1]))]
        bounds = np.zeros(n + 1, np.int64)
        bounds[1:] = np.cumsum(np.bincount(words.doc, weights=each, minlength=n).astype(np.int64))
        return out, bounds

    def batches(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For ranges of rows: first row, end, ids with the end id after each text, and bounds."""
        data, offsets = buffers(column)
        for i, j in slices(offsets, SLICE):
            ids, bounds = self.slice(data, offsets[i : j + 1])
            yield i, j, np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(len(bounds))
