"""Near-duplicates by SetSketch (operator 5).

A register is the truncated minimum of exponentially spaced values: for a set
with minimum hash *u* of an element under hash *j*, ``x = -ln(1 - u) / a`` is
the least of exponential variables and ``K = floor(1 - log_b(x))`` its register
(Ertl, "SetSketch: filling the gap between MinHash and HyperLogLog").  Registers
merge by maximum and agree with probability close to the Jaccard similarity.

1. Sets with equal fingerprints are one vertex; what follows sees each once.
2. Bands of registers are bucketed; :mod:`.cluster` says which members of a
   bucket are compared.
3. The similarity of a member and its bucket's hub is estimated from the counts
   of larger, smaller and equal registers by maximum likelihood.  A pair far
   below the threshold goes; all others are confirmed on their full shingle
   sets.  Members that are still apart are compared on their full sets alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import bucket_mates, cluster, pair_counts, vertices_of
from .common import by_bytes, collect_garbage, staged, text_buffers, unstage
from .decontaminate import bloom_filter

REGISTERS, ROWS = 128, 4  # 32 bands of 4: a pair at 0.75 shares none with probability 5e-6
BASE, RATE, TOP = 1.001, 20.0, 65534
#: A pair goes unconfirmed only if the threshold is less likely than the best estimate by exp(-MARGIN).
MARGIN = 14.0

_rng = np.random.default_rng(5)
_MUL = (_rng.integers(0, 1 << 63, REGISTERS, np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + _rng.integers(0, 2, REGISTERS, np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased (A-Z) words, and each text's first word (one more than texts)."""
    import xxhash

    data, offs = text_buffers(col)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inside = offs[:-1][offs[:-1] < len(data)]
    start[inside] = word[inside]
    c = np.concatenate([[0], np.cumsum(start)])
    first = c[offs]
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    dense = data[word]
    at = np.cumsum(word)[start] - 1
    words = pa.BinaryArray.from_buffers(pa.binary(), int(first[-1]), [None, pa.py_buffer(np.append(at, len(dense)).astype(np.int32)), pa.py_buffer(dense)])
    coded = words.dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    return table[coded.indices.to_numpy(zero_copy_only=False)], first


def shingle_sets(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted in each, and their offsets."""
    h, first = word_hashes(col)
    n = len(first) - 1
    acc = np.zeros(0, np.uint64)
    if len(h) >= width:
        acc = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            acc = acc * _P + h[k : len(h) - width + 1 + k]
        acc = mix(acc)
    sets = []
    for i in range(n):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= width:
            sets.append(np.unique(acc[lo : hi - width + 1]))
        elif hi > lo:
            v = np.uint64(hi - lo)
            with np.errstate(over="ignore"):
                for x in h[lo:hi]:
                    v = v * _P + x
            sets.append(mix(np.array([v ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    lens = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(lens)])


def registers(flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Registers (rows of ``REGISTERS``) of non-empty sets; rows of empty ones stay 0."""
    n = len(offs) - 1
    out = np.zeros((n, REGISTERS), np.uint64)
    full = np.flatnonzero(np.diff(offs))
    at = 0
    while at < len(full):  # blocks that stay in a core's cache
        end = at + 1
        while end < len(full) and offs[full[end] + 1] - offs[full[at]] <= 1 << 15:
            end += 1
        rows = full[at:end]
        block = flat[offs[rows[0]] : offs[rows[-1] + 1]]
        cuts = offs[rows] - offs[rows[0]]
        for j in range(REGISTERS):
            out[rows, j] = np.minimum.reduceat((block ^ _XOR[j]) * _MUL[j], cuts)
        at = end
    u = (out.astype(np.float64) + 0.5) / 2.0**64
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(-np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE) / np.log(BASE))
    return np.where(np.diff(offs)[:, None] > 0, np.clip(k, 0, TOP + 1), 0).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of a union."""
    return np.maximum(a, b)


def similarity(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, at: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """Most likely similarity of pairs of sketches with set sizes ``na``, ``nb``, and
    by how much its log-likelihood exceeds that of the similarity ``at``."""
    up, down = (ka > kb).sum(1), (ka < kb).sum(1)
    same = ka.shape[1] - up - down
    alpha = na / (na + nb)
    grid = np.linspace(0, 1, 101)[None, :]
    limit = (np.minimum(na, nb) / np.maximum(na, nb))[:, None]

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j):
        j = np.minimum(j, limit)
        hi, lo = p(alpha[:, None] - (1 - alpha)[:, None] * j), p((1 - alpha)[:, None] - alpha[:, None] * j)
        e = 1e-12
        return up[:, None] * np.log(hi + e) + down[:, None] * np.log(lo + e) + same[:, None] * np.log(np.clip(1 - hi - lo, 0, 1) + e)

    scores = score(grid)
    best = scores.argmax(1)
    return np.minimum(grid[0, best], limit[:, 0]), scores.max(1) - score(np.full((1, 1), at))[:, 0]


def plausible(ka, kb, na, nb, percent: int) -> np.ndarray:
    """Pairs that the likelihood does not rule out."""
    t = percent / 100
    j, lead = similarity(ka, kb, na, nb, t)
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((j >= t) | (lead < MARGIN))


def sketches(docs: DataFrame, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, f1, f2, sketch``: set size, fingerprint and registers."""
    src = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            flat, offs = shingle_sets(b.column(1), width)
            n = np.diff(offs)
            sums = np.concatenate([[0], np.cumsum(flat)]).astype(np.uint64), np.concatenate([[0], np.cumsum(mix(flat ^ _P))]).astype(np.uint64)
            f1, f2 = ((s[offs[1:]] - s[offs[:-1]]).view(np.int64) for s in sums)
            k = registers(flat, offs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1), pa.array(f2), pa.array([r.tobytes() for r in k], pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "sketch"])

    return src.mapInArrow(run, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, sketch binary")


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """One key per band of each sketch of ``v, sketch``."""
    for b in batches:
        k = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS // ROWS, ROWS)
        key = np.zeros(k.shape[:2], np.uint64) + np.arange(1, REGISTERS // ROWS + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key * _P + k[:, :, r].astype(np.uint64))
        yield key, b.column(0).to_numpy(), []


def _likely(pairs: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sketches leave the threshold possible."""
    one = vertices.select(F.col("v").alias("a"), F.col("sketch").alias("ka"), F.col("n_shingles").alias("na"))
    two = vertices.select(F.col("v").alias("b"), F.col("sketch").alias("kb"), F.col("n_shingles").alias("nb"))
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "ka", "kb", "na", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                ka, kb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (2, 3))
                ok = plausible(ka, kb, b.column(4).to_numpy().astype(float), b.column(5).to_numpy().astype(float), percent)
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return full.mapInArrow(run, "a bigint, b bigint")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``v, items``: the full sets of some documents, eight bytes a shingle."""
    here = bloom_filter(ids.select(F.xxhash64("v").alias("key")))  # texts of other documents are not shuffled
    src = docs.select(F.col("doc_id").alias("v"), "text").where(here(F.xxhash64("doc_id"))).join(ids, "v", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            flat, offs = shingle_sets(b.column(1), width)
            items = [flat[offs[i] : offs[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.binary())], ["v", "items"])

    return src.mapInArrow(run, "v bigint, items binary").dropDuplicates(["v", "items"])


def load_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a column of sets and their offsets."""
    data, offs = text_buffers(col)
    return np.frombuffer(data.tobytes(), np.uint64), offs // 8


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with ``100 * intersection >= percent * union`` on the full sets."""
    full = pairs.join(sets.select(F.col("v").alias("a"), F.col("items").alias("sa")), "a").join(sets.select(F.col("v").alias("b"), F.col("items").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for half in by_bytes(iter([whole]), "sa"):
                for b in by_bytes(iter([half]), "sb"):
                    n = b.num_rows
                    flat, offs = load_sets(pa.concat_arrays([b.column(2), b.column(3)]))
                    size, x = np.diff(offs), np.arange(n)
                    both = pair_counts(flat, offs, x, x + n)
                    yield b.select(["a", "b"]).filter(pa.array(100 * both >= percent * (size[:n] + size[n:] - both)))

    return full.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Null or blank text has an empty set: its own component.  Texts shorter than
    ``width`` words are one shingle.  Rows that repeat a ``doc_id`` are linked
    through it; a null ``doc_id`` has a null component and is kept.  An empty
    table gives an empty result.
    """
    base = staged(sketches(docs, width), "setsketch-documents")
    vertices = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("v"), F.first("sketch").alias("sketch"))
    vertices = staged(vertices, "setsketch-vertices")
    mates = bucket_mates(vertices.select("v", "sketch"), _signed)
    wanted = staged(vertices_of(mates), "setsketch-wanted")
    sets = staged(_sets(docs, wanted, width), "setsketch-sets")
    collect_garbage(docs.sparkSession)
    label = cluster(mates, lambda pairs: _confirm(_likely(pairs, vertices, percent), sets, percent), sets, load_sets, percent)
    unstage(sets, mates, wanted)
    named = base.join(vertices.select("f1", "f2", "n_shingles", "v"), ["f1", "f2", "n_shingles"], "left")
    out = named.join(label, "v", "left").select("doc_id", "n_shingles", F.coalesce("label", "v", "doc_id").alias("component_id"))
    out = staged(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "setsketch-out")
    unstage(base, vertices, label)
    return out
