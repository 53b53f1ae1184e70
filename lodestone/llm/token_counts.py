"""Token counts without token lists (operator 6).

Texts are cut at safe boundaries (:mod:`.pieces`), so a long text is split like
any other; the distinct pieces go to the library in batches of equal bytes and
only their lengths come back.  A text's count is the sum over its pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, small_batches, text_buffers
from .pieces import PieceCache, cut

#: Bytes of pieces in one call of the library.
BATCH_BYTES = 256 << 10

_loaded: dict[str, PieceCache] = {}


def batches_of(pieces: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Consecutive pieces in batches of about ``limit`` bytes; a longer piece is a batch of its own."""
    out, size = [], 0
    for p in pieces:
        n = len(p.encode())
        if out and size + n > limit:
            yield out
            out, size = [], 0
        out.append(p)
        size += n
    if out:
        yield out


def counter(path: str) -> PieceCache:
    """A cache from piece to count, for a ``.json`` or a ``.model`` vocabulary."""
    if path in _loaded:
        return _loaded[path]
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        lengths = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    else:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        lengths = lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = [n for b in batches_of(pieces) for n in lengths(b)]
        return np.array(out, np.int64), np.ones(len(out), np.int64)

    _loaded[path] = PieceCache(encode, np.int64)
    return _loaded[path]


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 2048, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``keep`` (default ``doc_id``), ``n_bytes``,
    ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).  No shuffle.

    Null text counts as empty (0 bytes, 0 tokens).  A SentencePiece model has no
    safe boundary inside a text, so there each text is one piece.
    """
    small_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = counter(vocab_path)
        for b in by_bytes(batches, "__text"):
            col = b.column(len(keep))
            data, offs = text_buffers(col)
            if vocab_path.endswith(".model"):
                texts = pa.array([x or "" for x in col.to_pylist()], pa.string())
                counts = cache.encode(texts.to_pylist())[0]
            else:
                # Greek capitals lower by context across punctuation: cut at white space only
                greek = bool(((data == 0xCE) | (data == 0xCF)).any())
                distinct, idx, first = cut(col, punct=not greek)
                counts = np.zeros(b.num_rows, np.int64)
                if len(idx):
                    rows = cache.rows(distinct)[idx]
                    counts = np.diff(np.concatenate([[0], np.cumsum(cache.flat[rows])])[first])
            cols = [b.column(k) for k in range(len(keep))]
            cols += [pa.array(np.diff(offs), pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit)]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "n_bytes", "n_tokens", "over_limit"])

    types = dict(src.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_bytes bigint, n_tokens bigint, over_limit boolean"
    return src.mapInArrow(run, schema)
