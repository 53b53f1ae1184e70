"""Line dedup with fuzzy lines (operator 9).

Equal lines are one class by a 128-bit hash; classes travel as packed arrays by
ranges of the hash, and a task sends on the first line of each of its classes
only.  Each distinct line has a MinHash signature over its character shingles;
bands of it are bucketed for candidates, which are confirmed by the exact
Jaccard similarity of the lines' shingle sets.
Links become components by distributed union-find (:mod:`.cluster`,
:mod:`.components`); of all lines of a component the first in order of
(``doc_id``, text hash, line number) stays.  Marks are kept per document and
text, so two rows that share a ``doc_id`` but not a text never mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import bucket_mates, cluster, pair_counts, vertices_of
from .common import by_bytes, collect_garbage, pack, partitions, runs, staged, text_buffers, unpack, unstage
from .decontaminate import bloom_filter

#: Characters of a shingle and percent of Jaccard similarity from which lines are linked, where a caller names none.
WIDTH, PERCENT = 10, 80
#: Characters of a shingle in op9 and the pipeline: a changed letter alters 5 shingles, so lines from 49 characters on stay linked.
SHORT_WIDTH = 5
#: 32 bands of 8: a pair at 0.8 shares none with probability 3e-3, at 0.85 with 4e-5; one at 0.15, as unrelated lines have short shingles in common, shares one with 8e-6
HASHES, ROWS = 256, 8
#: A line of fewer shingles has one hash function for each place of its signature, one of more has one
#: function for all places.  As similar sets differ by a fifth in size at most, what lies within that of
#: the bound is signed both ways; so is a long line of so few different shingles that it fills fewer bins
#: than ``5 * LONG / 4`` would (76 of 256, with a deviation of 5).
LONG, FEW_BINS = 72, 100
#: Lines that a task resolves and packs at once.
FLUSH = 200_000
#: Bytes of text whose lines are found or signed at once (a dozen 64-bit numbers for each character).
BAND_BYTES = 1 << 20
#: Characters hashed, and lines of 256 bins filled, at a time.
HASH_BLOCK, BIN_LINES = 1 << 15, 256

_rng = np.random.default_rng(9)
_ODD = _rng.integers(0, 1 << 32, HASHES).astype(np.uint32) | np.uint32(1)
_LENDERS = _rng.permuted(np.tile(np.arange(HASHES), (HASHES, 1)), axis=1).T.copy()  # from which bins an empty one borrows, in order
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def line_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, first and end byte of every line (split at line feeds), and whether it has a word."""
    n = len(offs) - 1
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(n), np.searchsorted(offs, breaks, "right") - 1])
    begin = np.concatenate([offs[:-1], breaks + 1])
    order = np.lexsort((begin, row))
    row, begin = row[order], begin[order]
    end = np.empty(len(begin), np.int64)
    if len(begin):
        end[:-1] = np.where(row[1:] == row[:-1], begin[1:] - 1, offs[row[:-1] + 1])
        end[-1] = offs[row[-1] + 1]
    number = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] if len(row) else np.zeros(0, np.int64)
    # lines lie one after the other, so what follows a line's begin up to the next is the line and its break
    ink = np.logical_or.reduceat(np.append(~_SPACE[data], False), begin) & (end > begin) if len(begin) else np.zeros(0, bool)
    return row, number, begin, end, ink


def line_ids(raw: memoryview, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of lines as two longs."""
    import xxhash

    both = b"".join([xxhash.xxh3_128_digest(raw[b:e]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
    pair = np.frombuffer(both, np.int64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


def shingle_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-character shingles of lines, and their offsets; shorter lines have none."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    lo, hi = at[begin], at[end]
    lens = np.maximum(hi - lo - width + 1, 0)
    if len(chars) < width or not lens.sum():
        return np.zeros(0, np.uint64), np.zeros(len(begin) + 1, np.int64)
    block, size, whole, done = chars + np.uint64(1), 1, None, 0
    powers = []
    while size <= width:  # blocks of 1, 2, 4 ... characters
        powers.append((size, block))
        block = block[:-size] * np.uint64(pow(int(_P), size, 2**64)) + block[size:]
        size *= 2
    for size, block in reversed(powers):
        if width & size:
            n = len(chars) - done - size + 1
            whole = block if whole is None else whole[:n] * np.uint64(pow(int(_P), size, 2**64)) + block[done : done + n]
            done += size
    ends = np.cumsum(lens)
    pos = np.arange(int(ends[-1])) + np.repeat(lo - (ends - lens), lens)
    return _mix(whole[pos]), np.concatenate([[0], ends])


def mixed_shingles(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of the shingles from every character on, and where those of each line begin and end."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    inner = np.flatnonzero(data.view(np.int8) < -64)  # bytes that begin no character
    lo, hi = begin - np.searchsorted(inner, begin), end - np.searchsorted(inner, end) - width + 1
    n = max(len(chars) - width + 1, 0)
    out, held = np.empty(n, np.uint32), np.empty(min(n, HASH_BLOCK), np.uint32)
    for at in range(0, n, HASH_BLOCK):  # blocks that stay in a core's cache
        h = out[at : at + HASH_BLOCK]
        m = len(h)
        x = held[:m]
        np.add(chars[at : at + m], np.uint32(1), out=h)
        for k in range(1, width):
            np.multiply(h, np.uint32(0x9E3779B1), out=h)
            np.add(h, chars[at + k : at + k + m], out=h)
        for shift, odd in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            np.right_shift(h, np.uint32(shift), out=x)
            np.bitwise_xor(h, x, out=h)
            np.multiply(h, np.uint32(odd), out=h)
    return out, lo, hi


def minhash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Signatures of the lines ``h[lo:hi]`` (not empty): the least hash times an odd number, for each of ``HASHES`` numbers."""
    out = np.empty((len(lo), HASHES), np.uint32)
    lens = hi - lo
    ends = np.cumsum(lens)
    e = h[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(lo - (ends - lens), lens)]
    cuts = ends - lens
    at = 0
    while at < len(lo):  # blocks that stay in a core's cache
        end = max(at + 1, int(np.searchsorted(ends, cuts[at] + (1 << 16))))
        block = e[cuts[at] : ends[end - 1]]
        part, held = np.empty((HASHES, end - at), np.uint32), np.empty_like(block)
        for j in range(HASHES):
            np.multiply(block, _ODD[j], out=held)
            np.minimum.reduceat(held, cuts[at:end] - cuts[at], out=part[j])
        out[at:end] = part.T
        at = end
    return out


def binned(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures of lines by one permutation, and how many bins each line fills.

    A shingle's hash names one of ``HASHES`` bins, which keeps its least; empty
    bins borrow from others in an order that is the same for all lines, so two
    lines agree in a bin with the probability of their similarity.
    """
    out, filled = np.empty((len(lo), HASHES), np.uint32), np.empty(len(lo), np.int64)
    shift = 32 - (HASHES - 1).bit_length()
    none = np.uint32(0xFFFFFFFF)
    for at in range(0, len(lo), BIN_LINES):  # blocks that stay in a core's cache
        some = slice(at, at + BIN_LINES)
        lens = hi[some] - lo[some]
        ends = np.cumsum(lens)
        row = np.repeat(np.arange(0, len(lens) * HASHES, HASHES), lens)
        e = h[np.arange(int(ends[-1])) + np.repeat(lo[some] - (ends - lens), lens)]
        own = np.full(len(lens) * HASHES, none)
        np.minimum.at(own, row + (e >> np.uint32(shift)), e & np.uint32((1 << shift) - 1))
        full = out[some].reshape(-1)
        full[:] = own
        empty = np.flatnonzero(own == none)
        filled[some] = HASHES - np.bincount(empty // HASHES, minlength=len(lens))
        bin_, k = empty % HASHES, 0
        while len(empty):
            got = own[empty - bin_ + _LENDERS[k][bin_]]
            full[empty] = got
            left = np.flatnonzero(got == none)
            empty, bin_ = empty[left], bin_[left]
            k += 1
    return out, filled


def band_keys(sig: np.ndarray, salt: int) -> np.ndarray:
    """One key per band of each signature."""
    band = sig.reshape(len(sig), HASHES // ROWS, ROWS)
    key = np.zeros(band.shape[:2], np.uint64) + np.arange(salt << 32, (salt << 32) + HASHES // ROWS, dtype=np.uint64)
    for r in range(0, ROWS, 2):
        key = (key + ((band[:, :, r].astype(np.uint64) << np.uint64(32)) | band[:, :, r + 1])) * _P
        key ^= key >> np.uint64(31)
    return _mix(key)


def signed_lines(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of the lines (bytes ``begin`` to ``end``) that have shingles, and which line each row is of."""
    h, lo, hi = mixed_shingles(data, begin, end, width)
    long = np.flatnonzero(hi - lo >= LONG)
    sig, filled = binned(h, lo[long], hi[long])
    few = (hi > lo) & (hi - lo <= LONG * 5 // 4)
    few[long[filled <= FEW_BINS]] = True
    short = np.flatnonzero(few)
    return np.concatenate([band_keys(minhash(h, lo[short], hi[short]), 1), band_keys(sig, 2)]), np.concatenate([short, long])


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, h, text`` with a hash of the text: what identifies a document here."""
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("h"), "text")


def _part(v: np.ndarray, parts: int) -> np.ndarray:
    return ((v.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _in_order(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """``doc_id, h, line, v, w`` sorted by class and place, each place once, and where a class begins."""
    doc, h, line, v, w = columns
    order = np.lexsort((line, h, doc, w, v.view(np.uint64)))
    order = order[runs(*(x[order] for x in columns))]  # rows that repeat id and text are one document
    doc, h, line, v, w = (x[order] for x in columns)
    return [doc, h, line, v, w], runs(v, w)


def _packed_classes(rows: list[tuple[np.ndarray, ...]], parts: int) -> list[tuple[int, bytes]]:
    """Packs of lines by range of their hash; lower than 0 the lines that have an equal one before them in this task."""
    columns, first = _in_order(*(np.concatenate(x) for x in zip(*rows, strict=True)))
    out = []
    if not first.all():  # sent to be marked, not to be compared
        out.append((-1 - int(columns[0][0] % parts), pack(*(x[~first] for x in columns))))
    columns = [x[first] for x in columns]
    cuts = np.searchsorted(_part(columns[3], parts), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        out.append((int(p), pack(*(x[cuts[p] : cuts[p + 1]] for x in columns))))
    return out


def _signed(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]]]]:
    """Band keys and ids of the lines of ``doc_id, h, text``, each line once a chunk, and packs of all lines."""
    rows, n = [], 0
    for b in by_bytes(batches, "text", BAND_BYTES):
        data, offs = text_buffers(b.column(2))
        data = np.ascontiguousarray(data)
        row, number, begin, end, ink = line_spans(data, offs)
        row, number, begin, end = row[ink], number[ink], begin[ink], end[ink]
        if not len(begin):
            continue
        v, w = line_ids(memoryview(data), begin, end)
        rows.append((b.column(0).to_numpy()[row], b.column(1).to_numpy()[row], number.astype(np.int32), v, w))
        n += len(v)
        long = np.flatnonzero(end - begin >= width)
        first = long[np.unique(v[long], return_index=True)[1]] if len(long) else long
        keys, line = signed_lines(data, begin[first], end[first], width)
        packs = []
        if n >= FLUSH:
            packs, rows, n = _packed_classes(rows, parts), [], 0
        yield keys, v[first][line], packs
    if rows:
        yield np.zeros((0, HASHES // ROWS), np.uint64), np.zeros(0, np.int64), _packed_classes(rows, parts)


def _classes(mates: DataFrame, parts: int) -> DataFrame:
    """``first, doc_id, h, line, v, w``: the first line of the classes that have mates, and of all classes the lines that are not the first."""

    def meet(packed: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = [unpack(p, np.int64, np.int64, np.int32, np.int64, np.int64) for p in packed["pack"].to_pylist()]
        if not rows:
            rows = [[np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int64, np.int64)]]
        columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
        if packed.num_rows and packed["part"][0].as_py() < 0:
            first = np.zeros(len(columns[0]), bool)
            keep = ~first
        else:
            columns, first = _in_order(*columns)
            keep = ~first | np.isin(columns[3], wanted["v"].to_numpy())
        doc, h, line, v, w = (x[keep] for x in columns)
        return pa.table({"first": pa.array(first[keep]), "doc_id": pa.array(doc, pa.int64()), "h": pa.array(h, pa.int64()), "line": pa.array(line, pa.int32()), "v": pa.array(v, pa.int64()), "w": pa.array(w, pa.int64())})

    packed = mates.where(F.col("pack").isNotNull()).select("part", "pack")
    part = F.shiftrightunsigned(F.shiftrightunsigned("v", 32) * F.lit(parts), 32).cast("int")
    wanted = vertices_of(mates.where(F.col("pack").isNull())).select(part.alias("part"), "v")
    return packed.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(meet, "first boolean, doc_id bigint, h bigint, line int, v bigint, w bigint")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``v, items`` (the lines) of lines given by ``doc_id, h, lines`` (an array of ``line, v``)."""
    here = bloom_filter(wanted.select(F.xxhash64("doc_id", "h").alias("key")))  # documents without such a line are not shuffled
    src = wanted.join(_keyed(docs).where(here(F.xxhash64("doc_id", "h"))), ["doc_id", "h"]).select("lines", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            vs, out = [], []
            for lines, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parts = (text or "").split("\n")
                for x in lines:
                    vs.append(x["v"])
                    out.append(parts[x["line"]])
            yield pa.RecordBatch.from_arrays([pa.array(vs, pa.int64()), pa.array(out, pa.string())], ["v", "items"])

    return src.mapInArrow(run, "v bigint, items string").dropDuplicates(["v"])


def line_sets(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (their upper 48 bits) of lines, and their offsets."""
    parts, lens = [], []
    for b in by_bytes(iter([pa.RecordBatch.from_arrays([col], ["line"])]), "line", BAND_BYTES):
        for lo in range(0, b.num_rows, 1 << 16):
            some = b.column(0).slice(lo, 1 << 16)
            data, offs = text_buffers(some)
            flat, o = shingle_hashes(np.ascontiguousarray(data), offs[:-1], offs[1:], width)
            key = np.sort((np.repeat(np.arange(len(some), dtype=np.uint64), np.diff(o)) << np.uint64(48)) | (flat >> np.uint64(16)))
            key = key[runs(key)]
            parts.append(key << np.uint64(16))
            lens.append(np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=len(some)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(np.concatenate(lens))] if lens else [[0]]).astype(np.int64)


def similar_pairs(a: pa.Array, b: pa.Array, percent: int, width: int) -> np.ndarray:
    """Which pairs of lines reach the threshold: exact Jaccard similarity of their shingle sets."""
    flat, offs = line_sets(pa.concat_arrays([a, b]), width)
    x = np.arange(len(a))
    both, size = pair_counts(flat, offs, x, x + len(a)), np.diff(offs)
    return (both > 0) & (100 * both >= percent * (size[: len(a)] + size[len(a) :] - both))


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    one, two = (texts.select(F.col("v").alias(c), F.col("items").alias(f"t{c}")) for c in "ab")
    full = pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_bytes(iter([whole]), "ta", BAND_BYTES):
                for c in by_bytes(iter([b]), "tb", BAND_BYTES):
                    yield c.select(["a", "b"]).filter(pa.array(similar_pairs(c.column(2), c.column(3), percent, width)))

    return full.mapInArrow(run, "a bigint, b bigint")


def removals(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """``doc_id, h, gone, fuzzy``: numbers of the lines to remove, and how many only resemble what stays."""
    spark = docs.sparkSession
    parts = 4 * partitions(spark)
    whole = bucket_mates(_keyed(docs), lambda batches: _signed(batches, width, parts))
    mates = whole.where(F.col("pack").isNull())
    classes = staged(_classes(whole, parts), "lines-classes")
    collect_garbage(spark)
    first = classes.where("first").select("v", "w", F.struct("doc_id", "h", "line").alias("first"))
    wanted = staged(first.groupBy("first.doc_id", "first.h").agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "v")).alias("lines")), "lines-wanted")
    texts = staged(_texts(docs, wanted), "lines-texts")
    collect_garbage(spark)
    label = cluster(mates, lambda pairs: _confirm(pairs, texts, percent, width), texts, lambda col: line_sets(col, width), percent)
    unstage(texts, whole, wanted)
    collect_garbage(spark)
    # of a component the first line stays; the classes of all others lose theirs as well
    linked = first.join(label, "v")
    heads = linked.groupBy("label").agg(F.min("first").alias("head"))
    losers = linked.join(heads, "label").where(F.col("first") != F.col("head")).select("v", "w", "first.*")
    again = classes.where("not first").join(losers.select("v", "w", F.lit(True).alias("fuzzy")), ["v", "w"], "left").select("doc_id", "h", "line", F.coalesce("fuzzy", F.lit(False)).alias("fuzzy"))
    marks = again.unionByName(losers.select("doc_id", "h", "line", F.lit(True).alias("fuzzy"))).select("doc_id", "h", F.struct("line", "fuzzy").alias("mark"))
    gone = marks.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("mark")).alias("marks"))
    gone = staged(gone.select("doc_id", "h", F.col("marks.line").alias("gone"), F.size(F.filter("marks", lambda m: m["fuzzy"])).cast("bigint").alias("fuzzy")), "lines-gone")
    unstage(classes, label)
    collect_garbage(spark)
    return gone


def dedup_lines(docs: DataFrame, percent: int = PERCENT, keep: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: ``keep`` (default ``doc_id``), ``text`` without the
    removed lines, ``n_lines``, ``n_removed``, ``n_fuzzy`` (removed although no equal line stays).

    Blank lines are never compared and always stay.  Lines shorter than a
    shingle (``width`` characters) are only compared for equality.  Null text stays null with no line;
    rows without ``doc_id`` are left alone; rows that repeat both ``doc_id`` and
    text are one document and lose the same lines, rows that repeat ``doc_id``
    alone are documents of their own; an empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    gone = removals(docs, percent, width)
    src = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h"), *[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text")).join(gone.withColumnsRenamed({"doc_id": "__id", "h": "__h"}), ["__id", "__h"], "left").select(*[F.col(f"`{c}`") for c in keep], "__text", "gone", F.coalesce("fuzzy", F.lit(0).cast("bigint")).alias("fuzzy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keep)
        for b in by_bytes(batches, "__text"):
            text, cuts = b.column(k), b.column(k + 1)
            n_lines = pc.fill_null(pc.add(pc.count_substring(text, "\n"), 1), 0)
            cut = pc.and_(cuts.is_valid(), text.is_valid())
            some, n_gone = [], np.zeros(b.num_rows, np.int64)
            for i in np.flatnonzero(cut.to_numpy(zero_copy_only=False)).tolist():  # all others pass as they are
                parts, drop = text[i].as_py().split("\n"), set(cuts[i].as_py())
                left = [x for j, x in enumerate(parts) if j not in drop]
                n_gone[i] = len(parts) - len(left)
                some.append("\n".join(left))
            text = pc.replace_with_mask(text, cut, pa.array(some, text.type))
            cols = [b.column(i) for i in range(k)] + [text, pc.cast(n_lines, pa.int64()), pa.array(n_gone), b.column(k + 2)]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "text", "n_lines", "n_removed", "n_fuzzy"])

    types = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", text string, n_lines bigint, n_removed bigint, n_fuzzy bigint")
