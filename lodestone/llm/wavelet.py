"""Token ids in wavelet-matrix shard files (operator 1).

A shard holds the ids of a range of ``doc_id``s as bit-planes, most significant
first: plane *k* has the *k*-th bit of every id, in the order in which the
planes before it sorted them (zeros first, stably).  With a count of ones per
512 bits, ``access``, ``rank`` (occurrences before a position) and ``select``
(where the *j*-th occurrence is) take one step per plane on the packed bits.
A whole shard is decoded by undoing the sorts from the last plane up.

Files are Parquet: one row per shard, its planes and directories binary
columns, so any store that Spark writes to can hold them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import by_bytes, ragged, small_batches
from .pieces import PieceCache

#: A shard is closed at the first document after this many ids.
SHARD_TOKENS = 2 << 20
BLOCK = 512  # bits for each entry of a rank directory

SCHEMA = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("zeros", T.ArrayType(T.LongType())),
        T.StructField("planes", T.ArrayType(T.BinaryType())),
        T.StructField("ranks", T.ArrayType(T.BinaryType())),
    ]
)


class WaveletMatrix:
    """Rank/select structure over a sequence of ids."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        bits = max(1, top.bit_length()) if bits is None else bits
        x = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for k in range(bits - 1, -1, -1):
            one = (x & x.dtype.type(1 << k)) != 0
            packed = np.packbits(one, bitorder="little")
            pad = np.zeros(-(-max(len(packed), 1) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            pad[: len(packed)] = packed
            counts = np.bitwise_count(pad.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            planes.append(pad)
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32))
            low, high = np.flatnonzero(~one), np.flatnonzero(one)  # a third of the time that masks take
            zeros.append(len(low))
            x = np.concatenate([x[low], x[high]])
        return cls(len(ids), zeros, planes, ranks)

    @classmethod
    def load(cls, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> WaveletMatrix:
        return cls(n, list(zeros), [np.frombuffer(p, np.uint8) for p in planes], [np.frombuffer(r, np.uint32) for r in ranks])

    def _ones(self, k: int, pos: np.ndarray) -> np.ndarray:
        """Ones of plane ``k`` before each position."""
        pos = np.asarray(pos, np.int64)
        block, words = pos // BLOCK, self.planes[k].view(np.uint64)
        out = self.ranks[k][block].astype(np.int64)
        word = block * (BLOCK // 64)
        rest = pos - block * BLOCK
        for j in range(BLOCK // 64):
            left = np.clip(rest - 64 * j, 0, 64)
            mask = np.where(left >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(words[np.minimum(word + j, len(words) - 1)] & mask).astype(np.int64) * (left > 0)
        return out

    def access(self, positions) -> np.ndarray:
        """The ids at some positions."""
        p = np.asarray(positions, np.int64)
        out = np.zeros(p.shape, np.int64)
        for k in range(len(self.planes)):
            bit = (self.planes[k][p >> 3] >> (p & 7).astype(np.uint8)) & 1
            ones = self._ones(k, p)
            out = out << 1 | bit
            p = np.where(bit == 1, self.zeros[k] + ones, p - ones)
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for k in range(len(self.planes)):
            a, b = (int(v) for v in self._ones(k, np.array([lo, hi])))
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (len(self.planes) - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, end: int) -> int:
        """Occurrences of ``token`` before position ``end``."""
        if token >> len(self.planes):
            return 0
        lo, hi = self._range(token, end)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Position of occurrence ``j`` (from 0) of ``token``."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        at = self._range(token, self.n)[0] + j
        for k in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - k) & 1
            want = at - self.zeros[k] if one else at
            lo, hi = 0, self.n - 1
            while lo < hi:  # the first position whose prefix has want + 1 such bits
                mid = (lo + hi) // 2
                ones = int(self._ones(k, np.array([mid + 1]))[0])
                if (ones if one else mid + 1 - ones) > want:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at

    def decode(self) -> np.ndarray:
        """All ids."""
        bits = len(self.planes)
        x = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for k in range(bits - 1, -1, -1):
            one = np.unpackbits(self.planes[k], count=self.n, bitorder="little").astype(bool)
            y = np.empty_like(x)
            y[np.flatnonzero(~one)] = x[: self.zeros[k]]
            y[np.flatnonzero(one)] = x[self.zeros[k] :] | x.dtype.type(1 << (bits - 1 - k))
            x = y
        return x


_encoders: dict[str, tuple[PieceCache, int]] = {}


def encoder(path: str) -> tuple[PieceCache, int]:
    """A cache over the tokenizers library, and the bits of its largest id.

    Pieces that start with white space and end with a visible character may be
    put side by side, as in a text; the ids are cut where the bytes of their
    tokens reach the end of a piece.
    """
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        size = t.get_vocab_size()
        lens = np.array([len(t.id_to_token(k) or "") for k in range(size)], np.int64)

        def alone(pieces: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(pieces, add_special_tokens=False)]

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            size = pc.binary_length(pa.array(pieces, pa.string())).to_numpy()
            parts, counts, order = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], []
            joined = [k for k, p in enumerate(pieces) if p[0] in " \n" and p[-1].isascii() and p[-1] > " " and "|" not in p]
            for lo in range(0, len(joined), 512):
                group = joined[lo : lo + 512]
                ids = alone(["".join([pieces[k] for k in group])])[0]
                ends = np.cumsum(size[group])
                reach = np.cumsum(lens[ids])
                cuts = np.searchsorted(reach, ends)
                if len(reach) and reach[-1] == ends[-1] and (reach[cuts] == ends).all():
                    parts.append(ids)
                    counts.append(np.diff(cuts, prepend=-1))
                    order += group
            left = np.ones(len(pieces), bool)
            left[order] = False
            rest = np.flatnonzero(left).tolist()
            single = alone([pieces[k] for k in rest])
            flat, n = np.concatenate(parts + single), np.concatenate([*counts, np.array([len(x) for x in single], np.int64)])
            place = np.argsort(np.array(order + rest, np.int64))
            return flat[ragged(np.concatenate([[0], np.cumsum(n)]), place)[0]], n[place]

        _encoders[path] = (PieceCache(encode, np.uint32), max(1, (size - 1).bit_length()))
    return _encoders[path]


def write_shards(docs: DataFrame, vocab_path: str, path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` (``doc_id``, ``text``) and write shard files to ``path``.

    Documents are range-partitioned by ``doc_id`` and sorted inside a range, so
    shards in order of (``shard``, ``part``) hold ascending ``doc_id``s; equal ids
    are ordered by text, null ids come first.  Null text counts as empty; every
    document ends with ``end_id``.  An empty table writes no shard.
    """
    small_batches(docs.sparkSession)
    src = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bits = encoder(vocab_path)
        shard, part = TaskContext.get().partitionId(), 0
        ids, doc_ids, lengths, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            w = WaveletMatrix.build(np.concatenate(ids), bits)
            row = [shard, part, w.n, np.concatenate(doc_ids).tolist(), np.concatenate(lengths).tolist(), w.zeros, [p.tobytes() for p in w.planes], [r.tobytes() for r in w.ranks]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _arrow, strict=True)], SCHEMA.names)

        for b in by_bytes(batches, "text"):
            flat, offs = cache.texts(b.column(1))
            n = b.num_rows
            out = np.full(len(flat) + n, end_id, np.uint32)
            out[np.arange(len(flat)) + np.repeat(np.arange(n), np.diff(offs))] = flat
            ids.append(out)
            doc_ids.append(np.array(b.column(0).to_pylist(), object))
            lengths.append(np.diff(offs) + 1)
            held += len(out)
            if held >= shard_tokens:
                yield close()
                part += 1
                ids, doc_ids, lengths, held = [], [], [], 0
        if held:
            yield close()

    src.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


_arrow = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    Totals are summed up in order, first of the files of one writer, then of the
    writers (one row each); the documents' own rows never meet in one task.
    """
    files = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard, part, n, doc_ids, lengths, zeros, planes, ranks = (c[i].as_py() for c in b.columns)
                view = memoryview(WaveletMatrix.load(n, zeros, planes, ranks).decode().astype("<u4")).cast("B")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(view[4 * int(s) : 4 * int(e)]) for s, e in zip(starts, ends, strict=True)]
                m = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * m, pa.int64()), pa.array([part] * m, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["shard", "part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = files.mapInArrow(run, "shard bigint, part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    writers = files.groupBy("shard").agg(F.sum("n_tokens").alias("total")).select("shard", before(Window.orderBy("shard"), "total").alias("ahead"))
    parts = files.select("shard", "part", before(Window.partitionBy("shard").orderBy("part"), "n_tokens").alias("inside"))
    bases = parts.join(writers, "shard").select("shard", "part", (F.col("ahead") + F.col("inside")).alias("base"))
    return rows.join(bases, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Occurrences of a token per shard file, counted on the packed planes."""
    files = spark.read.schema(SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard, part, n, _, _, zeros, planes, ranks = (c[i].as_py() for c in b.columns)
                w = WaveletMatrix.load(n, zeros, planes, ranks)
                count = w.count(token)
                first = w.select(token, 0) if count else None
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((shard, pa.int64()), (part, pa.int32()), (count, pa.int64()), (first, pa.int64()))], ["shard", "part", "n", "first_at"])

    return files.mapInArrow(run, "shard bigint, part int, n bigint, first_at bigint")
