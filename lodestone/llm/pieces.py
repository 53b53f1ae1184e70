"""Text cut at boundaries that no pre-tokenizer token crosses.

A boundary lies before white space that follows a visible character, and
between an ASCII letter and the punctuation after it.  Encoding the pieces one
by one gives the ids of the whole text, so each distinct piece is encoded once
and kept; the text itself is only looked up.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import ragged, text_buffers

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_ANY_SPACE = np.zeros(256, bool)
_ANY_SPACE[[*range(9, 14), *range(0x1C, 0x21)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?)*&%$#\""]] = True


def _wide_space(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether the bytes end a white-space character outside ASCII (or may do so)."""
    return (
        ((before == 0xC2) & ((last == 0x85) | (last == 0xA0)))
        | ((before == 0x9A) & (last == 0x80))
        | ((before == 0x80) & ((last <= 0x8A) | (last == 0xA8) | (last == 0xA9) | (last == 0xAF)))
        | ((before == 0x81) & (last == 0x9F))
    )


def cut(col: pa.Array, punct: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces, the index of each piece in them, and each text's first piece
    (one entry more than texts)."""
    data, offs = text_buffers(col)
    n = len(data)
    if n == 0:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    flag = np.zeros(n + 1, bool)
    at = np.flatnonzero(_SPACE[data[1:]] & ~_ANY_SPACE[data[:-1]]) + 1
    high = data[at - 1] >= 0x80
    if high.any():
        last = data[at - 1]
        before = np.where(at >= 2, data[np.maximum(at - 2, 0)], 0)
        at = at[~(high & _wide_space(last, before))]
    flag[at] = True
    if punct:
        flag[1:n] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
    flag[offs] = True
    flag[n] = True
    starts = np.flatnonzero(flag)
    pieces = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    coded = pieces.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(starts, offs)


class PieceCache:
    """Encodings of pieces seen so far; at most ``limit`` pieces are kept."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, limit: int = 400_000):
        self.encode, self.dtype, self.limit = encode, dtype, limit
        self.clear()

    def clear(self) -> None:
        self.keys = pa.array([], pa.string())
        self.flat = np.zeros(0, self.dtype)
        self.offs = np.zeros(1, np.int64)

    def rows(self, distinct: pa.Array) -> np.ndarray:
        """Where the cache has each piece; unknown ones are encoded first."""
        if len(self.keys) > self.limit:
            self.clear()
        found = pc.index_in(distinct, value_set=self.keys)
        if found.null_count:
            missing = distinct.filter(pc.is_null(found))
            flat, lens = self.encode(missing.to_numpy(zero_copy_only=False).tolist())
            base = len(self.keys)
            self.keys = pa.concat_arrays([self.keys, missing])
            self.flat = np.concatenate([self.flat, flat.astype(self.dtype)])
            self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(lens)])
            out = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            out[out < 0] = base + np.arange(len(missing))
            return out
        return found.to_numpy(zero_copy_only=False).astype(np.int64)

    def texts(self, col: pa.Array, punct: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Values of all texts, and each text's offset into them (one more than texts)."""
        distinct, idx, first = cut(col, punct)
        if not len(idx):
            return np.zeros(0, self.dtype), np.zeros(len(first), np.int64)
        rows = self.rows(distinct)[idx]
        pos, lens = ragged(self.offs, rows)
        ends = np.concatenate([[0], np.cumsum(lens)])
        return self.flat[pos], ends[first]

