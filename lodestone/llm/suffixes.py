"""Removal of repeated byte strings by a distributed suffix array (operator 3).

A byte goes if it lies in a ``WIDTH``-byte string that also starts in a document
with a smaller ``doc_id``.  Sorting every suffix of a corpus would shuffle each
byte ``WIDTH`` times, so an exact filter first finds the suffixes that can have
an equal beginning elsewhere:

1. *Anchors.*  In every window of ``WIDTH`` bytes the ``GRAM``-byte string with
   the least hash is its anchor; equal windows have equal anchors in the same
   place.  Anchors travel as hashes only, packed by hash range.  An anchor whose
   whole surroundings (all windows around it) also occur in a smaller document
   settles its windows at once; anchors of one document alone are dropped.
2. *Suffixes.*  What is left are windows around anchors that documents share
   while the surroundings differ.  Their suffixes, cut at ``WIDTH`` bytes, are
   range-partitioned by their bytes with splitters from a bounded
   sample, sorted in each bucket by multikey quicksort on words of eight bytes,
   and compared with their neighbours: in a run of equal suffixes all but those
   of the smallest document are marked.  Splitters are whole strings of ``WIDTH``
   bytes, so a beginning that very many suffixes share is cut as finely as any,
   and equal strings fall on one side of a boundary.  Suffixes travel in
   ``ROUNDS`` parts by a hash of theirs, one after the other, so the disk holds
   one part at a time.

Both steps first resolve equal strings inside a task and send only those of the
task's smallest document, so a passage that a third of all documents share
arrives once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, collect_garbage, pack, partitions, runs, staged, text_buffers, unpack, unstage

WIDTH, GRAM = 50, 16
LEFT = WIDTH - GRAM  # windows around an anchor start up to so many bytes before it
HALF = LEFT // 2
#: Anchors, or suffixes, that a task resolves and packs at once.
FLUSH_ANCHORS, FLUSH_SUFFIXES = 1_500_000, 300_000
#: Bytes of text whose anchors are found at once (a dozen 64-bit numbers for each byte).
ANCHOR_BYTES = 1 << 20
#: Parts in which the suffixes are shuffled and compared.
ROUNDS = 2
#: Documents from which splitters are sampled (a bound; it affects balance only).
SAMPLE_DOCS = 400
PAD = 0xFF  # no byte of UTF-8

_P = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _join(a: np.ndarray, b: np.ndarray, la: int, lb: int) -> np.ndarray:
    """Polynomial hashes of strings of ``la + lb`` bytes from those of ``la`` and of ``lb``."""
    m = len(b) - la
    return a[:m] * np.uint64(pow(_P, lb, 1 << 64)) + b[la : la + m]


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` over every ``w`` consecutive values."""
    n = 1
    while 2 * n <= w:
        x = op(x[:-n], x[n:])
        n *= 2
    return op(x[: len(x) - (w - n)], x[w - n :]) if n < w else x


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, position, hash, hash of the surroundings and the hashes (one byte each) of
    the nearer left and right of every anchor."""
    n = len(offs) - 1
    gap = WIDTH
    at = offs[:-1] + gap * np.arange(1, n + 1)  # where texts begin between runs of PAD
    lens = np.diff(offs)
    x = np.full(len(data) + gap * (n + 1), PAD, np.uint8)
    row = np.repeat(np.arange(n), lens)
    x[np.arange(len(data)) + gap * (row + 1)] = data
    h1 = _mix(x.astype(np.uint64) + np.uint64(1))
    h2 = _join(h1, h1, 1, 1)
    h4 = _join(h2, h2, 2, 2)
    h8 = _join(h4, h4, 4, 4)
    h16 = _join(h8, h8, 8, 8)
    h32 = _join(h16, h16, 16, 16)
    h33 = _join(h32, h1, 32, 1)
    h50 = _join(_join(h32, h16, 32, 16), h2, 48, 2)
    key = _mix(h16)
    least = _slide(key, LEFT + 1, np.minimum)  # of the window that starts here
    full = np.zeros(len(least), bool)
    starts = np.maximum(lens - WIDTH + 1, 0)
    ends = np.cumsum(starts)
    if not n or not ends[-1]:
        z = np.zeros(0, np.int64)
        return z, z, z.view(np.uint64), z.view(np.uint64), z.astype(np.uint8), z.astype(np.uint8)
    full[np.arange(int(ends[-1])) + np.repeat(at - (ends - starts), starts)] = True
    held = np.where(full, least, np.uint64(0))
    most = _slide(np.concatenate([np.zeros(LEFT, np.uint64), held]), LEFT + 1, np.maximum)
    p = np.flatnonzero(most == key[: len(most)])
    p = p[most[p] > 0]
    row = np.searchsorted(at, p, "right") - 1
    around = _mix(h50[p - LEFT] * np.uint64(_P) + _mix(h50[p] ^ np.uint64(0xABCDEF)))  # 64 bits of both sides together
    near_left, near_right = (_mix(h) >> np.uint64(56) for h in (h33[p - HALF], h33[p]))
    return row, p - at[row], key[p], around, near_left.astype(np.uint8), near_right.astype(np.uint8)


def _least(doc: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Smallest document of each entry's run."""
    return np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1] if len(doc) else doc


#: What a shuffled row holds: a pack for a bucket, or finished marks.
PACKED = "bucket int, pack binary"
MARKS = "doc_id bigint, tag int, pos int, kind int"
COVERED, TRY_LEFT, TRY_RIGHT, WINDOW = 0, 1, 2, 4  # kinds of marks; TRY_* may be added up


def _place(pos: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """A position with the tag of its text (0 but for texts that share a ``doc_id``) above it."""
    return pos.astype(np.uint64) | (tag.astype(np.uint64) << np.uint64(32))


def _marks(doc: np.ndarray, pos: np.ndarray, kind) -> pa.RecordBatch:
    kind = np.broadcast_to(np.asarray(kind, np.int32), len(doc))
    pos = pos.astype(np.uint64)
    tag, pos = (pos >> np.uint64(32)).astype(np.int32), (pos & np.uint64(0xFFFFFFFF)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(tag), pa.array(pos), pa.array(np.ascontiguousarray(kind))], ["doc_id", "tag", "pos", "kind"])


def _spread(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "pack"])


def _pack_anchors(parts: list[tuple[np.ndarray, ...]], buckets: int) -> list[tuple[int, bytes]]:
    doc, pos, key, around, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((doc, around, key))
    doc, pos, key, around, lo, hi = (x[order] for x in (doc, pos, key, around, lo, hi))
    keep = doc == _least(doc, runs(key, around))
    out = []
    if (~keep).any():  # settled inside the task
        gone = doc[~keep]
        ids, at = np.unique(gone, return_inverse=True)
        out.append((-1 - int(ids[0] % buckets), pack(np.diff(ids, prepend=0), at.astype(np.uint32), pos[~keep])))
    doc, pos, key, around, lo, hi = (x[keep] for x in (doc, pos, key, around, lo, hi))
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in range(buckets):
        s = slice(cuts[b], cuts[b + 1])
        if s.start < s.stop:
            ids, at = np.unique(doc[s], return_inverse=True)
            out.append((b, pack(np.diff(ids, prepend=0), at.astype(np.uint32), pos[s], np.diff(key[s], prepend=np.uint64(0)), around[s], lo[s], hi[s])))
    return out


def _shared(packs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Marks of one hash range: settled anchors, and those whose suffixes have to be sorted."""
    parts = []
    for p in packs:
        ids, at, pos, key, around, lo, hi = unpack(p, np.int64, np.uint32, np.uint64, np.uint64, np.uint64, np.uint8, np.uint8)
        parts.append((np.cumsum(ids)[at], pos, np.cumsum(key, dtype=np.uint64), around, lo, hi))
    doc, pos, key, around, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    doc, pos, key, around, lo, hi = (x[order] for x in (doc, pos, key, around, lo, hi))
    new = runs(key)
    begin = np.flatnonzero(new)
    several = (np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin))[np.cumsum(new) - 1]
    doc, pos, key, around, lo, hi = (x[several] for x in (doc, pos, key, around, lo, hi))
    if not len(doc):
        return
    order = np.lexsort((doc, around, key))
    doc, pos, key, around, lo, hi = (x[order] for x in (doc, pos, key, around, lo, hi))
    first = doc == _least(doc, runs(key, around))
    yield _marks(doc[~first], pos[~first], COVERED)
    doc, pos, key, lo, hi = (x[first] for x in (doc, pos, key, lo, hi))
    kind = np.zeros(len(doc), np.int32)
    for near, bit in ((lo, TRY_LEFT), (hi, TRY_RIGHT)):
        order = np.lexsort((near, key))
        new = runs(key[order], near[order])
        begin = np.flatnonzero(new)
        d = doc[order]
        kind[order] |= bit * (np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin))[np.cumsum(new) - 1]
    yield _marks(doc[kind > 0], pos[kind > 0], kind[kind > 0])


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of 64-bit words: sorted by a word, then only the ranges of
    equal ones by the next, as multikey quicksort does with characters."""
    order = np.argsort(words[:, 0], kind="stable")
    same = np.zeros(len(order), bool)
    if len(order):
        first = words[order, 0]
        same[1:] = first[1:] == first[:-1]
    for depth in range(1, words.shape[1]):
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(~same)[at]
        value = words[order[at], depth]
        sub = np.lexsort((value, group))
        order[at] = order[at[sub]]
        value, group = value[sub], group[sub]
        still = np.zeros(len(at), bool)
        still[1:] = (value[1:] == value[:-1]) & (group[1:] == group[:-1])
        same[at] = still
    return order


def _words(strings: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(strings), -(-WIDTH // 8) * 8), np.uint8)
    wide[:, :WIDTH] = strings
    return wide.view(">u8").astype(np.uint64)


def _sorted(strings: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Suffixes in order, and the smallest document of each run of equal ones."""
    words = _words(strings)
    order = multikey_order(words)
    words = words[order]
    new = runs(*words.T)
    return strings[order], doc[order], pos[order], _least(doc[order], new)


def _pack_suffixes(strings: np.ndarray, doc: np.ndarray, pos: np.ndarray, splitters: np.ndarray) -> list[tuple[int, bytes]]:
    strings, doc, pos, least = _sorted(strings, doc, pos)
    out, keep = [], doc == least
    if (~keep).any():
        ids, at = np.unique(doc[~keep], return_inverse=True)
        out.append((-1 - int(ids[0] % (len(splitters) + 1)), pack(np.diff(ids, prepend=0), at.astype(np.uint32), pos[~keep])))
    strings, doc, pos = np.ascontiguousarray(strings[keep]), doc[keep], pos[keep]
    cuts = [0, *np.searchsorted(strings.view(f"S{WIDTH}").ravel(), splitters, "left").tolist(), len(doc)]
    for b in range(len(cuts) - 1):
        s = slice(cuts[b], cuts[b + 1])
        if s.start < s.stop:
            ids, at = np.unique(doc[s], return_inverse=True)
            out.append((b, pack(strings[s], np.diff(ids, prepend=0), at.astype(np.uint32), pos[s])))
    return out


def _compared(packs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Marks of one bucket of the suffix array."""
    parts = []
    for p in packs:
        strings, ids, at, pos = unpack(p, np.uint8, np.int64, np.uint32, np.uint64)
        parts.append((strings.reshape(-1, WIDTH), np.cumsum(ids)[at], pos))
    _, doc, pos, least = _sorted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    yield _marks(doc[doc > least], pos[doc > least], WINDOW)


def _reduce(packed: DataFrame, solve, settled_kind: int) -> DataFrame:
    """Bring the packs of a bucket together and turn them into marks."""

    def run(t: pa.Table) -> pa.Table:
        bucket, packs = t["bucket"][0].as_py(), t["pack"].to_pylist()
        out = []
        if bucket < 0:
            for p in packs:
                ids, at, pos = unpack(p, np.int64, np.uint32, np.uint64)
                out.append(_marks(np.cumsum(ids)[at], pos, settled_kind))
        else:
            out = list(solve(packs))
        return pa.Table.from_batches(out or [_marks(np.zeros(0), np.zeros(0), 0)])

    return packed.groupBy("bucket").applyInArrow(run, MARKS)


def _tagged(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__tag``: 0, or a number for each of several texts that share a ``doc_id``."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h")).where(F.col("doc_id").isNotNull())
    several = staged(keyed.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where(F.col("lo") < F.col("hi")).select("doc_id"), "suffixes-shared-ids")
    if several.isEmpty():
        unstage(several)
        return docs.withColumn("__tag", F.lit(0))
    tag = F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))
    tags = staged(keyed.join(several, "doc_id", "left_semi").distinct().withColumn("tag", tag), "suffixes-tags").select(F.col("doc_id").alias("__d"), F.col("h").alias("__g"), "tag")
    return docs.join(tags, (docs["doc_id"] == F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__g")), "left").withColumn("__tag", F.coalesce("tag", F.lit(0))).drop("__d", "__g", "tag")


def _windows(text: np.ndarray, p: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Starts of a text's windows around anchors ``p`` of the kinds ``k``."""
    left, right = np.arange(HALF, LEFT + 1), np.arange(0, HALF)
    starts = np.unique(np.concatenate([(p[k & TRY_LEFT > 0][:, None] - left).ravel(), (p[k & TRY_RIGHT > 0][:, None] - right).ravel()]))
    return starts[(starts >= 0) & (starts <= len(text) - WIDTH)]


def _round_of(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The round in which each window is compared, by its first and last eight bytes."""
    words = np.lib.stride_tricks.sliding_window_view(text, 8)
    first, last = (np.ascontiguousarray(words[starts + d]).view("<u8").ravel() for d in (0, WIDTH - 8))
    return _mix(first * np.uint64(_P) + _mix(last)) % np.uint64(ROUNDS)


def _candidates(batches: Iterator[pa.RecordBatch], turn: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows that are to be sorted (in round ``turn``), their documents and places, of ``doc_id, __tag, text, tries``."""
    for b in by_bytes(batches, "text"):
        data, offs = text_buffers(b.column(2))
        lists = b.column(3)
        at = lists.offsets.to_numpy()
        p_all, k_all = (lists.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "kind"))
        ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
        for i in range(b.num_rows):
            text = data[offs[i] : offs[i + 1]]
            starts = _windows(text, p_all[at[i] : at[i + 1]], k_all[at[i] : at[i + 1]])
            if turn is not None and len(starts):
                starts = starts[_round_of(text, starts) == turn]
            if len(starts):
                yield np.lib.stride_tricks.sliding_window_view(text, WIDTH)[starts], np.full(len(starts), ids[i]), _place(starts, np.full(len(starts), tags[i]))


def _splitters(tried: DataFrame, buckets: int) -> np.ndarray:
    """Strings that cut the windows of a bounded sample of documents into even ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for strings, _, _ in _candidates(batches):
            some = np.ascontiguousarray(strings[:: max(1, len(strings) // 50)])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in some], pa.binary())], ["s"])

    found = np.sort(np.array([bytes(r[0]) for r in tried.limit(SAMPLE_DOCS).mapInArrow(run, "s binary").collect()], f"S{WIDTH}"))
    return np.unique(found[(np.arange(1, buckets) * len(found)) // buckets]) if len(found) else found


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, marks``: per text with repeated bytes an array of marks ``pos, kind``; ``docs`` has ``__tag``."""
    spark = docs.sparkSession
    src = docs.select("doc_id", "__tag", "text").where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WIDTH))
    buckets = 4 * partitions(spark)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in by_bytes(batches, "text", ANCHOR_BYTES):
            row, pos, key, around, lo, hi = anchors(*text_buffers(b.column(2)))
            parts.append((b.column(0).to_numpy()[row], _place(pos, b.column(1).to_numpy()[row]), key, around, lo, hi))
            held += len(row)
            if held >= FLUSH_ANCHORS:
                yield _spread(_pack_anchors(parts, buckets))
                parts, held = [], 0
        if held:
            yield _spread(_pack_anchors(parts, buckets))

    marks = staged(_reduce(src.mapInArrow(find, PACKED), _shared, COVERED), "suffixes-anchors")
    collect_garbage(spark)

    tries = marks.where(F.col("kind") > 0).groupBy("doc_id", F.col("tag").alias("__tag")).agg(F.collect_list(F.struct("pos", "kind")).alias("tries"))
    # written once, so the shuffle of the texts is gone before the suffixes' begin, and no round repeats it
    tried = staged(src.join(tries, ["doc_id", "__tag"]).select("doc_id", "__tag", "text", "tries"), "suffixes-tried")
    collect_garbage(spark)
    splitters = _splitters(tried, buckets)

    def windows(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts, held = [], 0
            for part in _candidates(batches, turn):
                parts.append(part)
                held += len(part[1])
                if held >= FLUSH_SUFFIXES:
                    yield _spread(_pack_suffixes(*(np.concatenate(x) for x in zip(*parts, strict=True)), splitters))
                    parts, held = [], 0
            if held:
                yield _spread(_pack_suffixes(*(np.concatenate(x) for x in zip(*parts, strict=True)), splitters))

        return run

    rounds = []
    for turn in range(ROUNDS):
        rounds.append(staged(_reduce(tried.mapInArrow(windows(turn), PACKED), _compared, WINDOW), f"suffixes-windows-{turn}"))
        collect_garbage(spark)
    unstage(tried)
    more = reduce(DataFrame.unionByName, rounds)
    found = staged(marks.where(F.col("kind") == COVERED).unionByName(more).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("pos", "kind")).alias("marks")), "suffixes-found")
    unstage(marks, *rounds)
    return found


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``keep`` (default ``doc_id``), ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256``; on request the ``kept`` bytes.

    Null text counts as empty; texts of fewer than ``WIDTH`` bytes lose nothing;
    rows without ``doc_id`` neither give nor take; rows that repeat ``doc_id`` and
    text lose the same bytes, texts that share a ``doc_id`` neither give nor take
    between them; an empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    tagged = _tagged(docs.select("doc_id", *[F.col(f"`{c}`").alias(f"__keep{k}") for k, c in enumerate(keep)], "text"))
    found = repeated(tagged).withColumnsRenamed({"doc_id": "__id", "tag": "__tag"})
    src = tagged.select(F.col("doc_id").alias("__id"), "__tag", *[F.col(f"__keep{k}").alias(c) for k, c in enumerate(keep)], F.col("text").alias("__text")).join(found, ["__id", "__tag"], "left").select(*[F.col(f"`{c}`") for c in keep], "__text", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(keep)
        for b in by_bytes(batches, "__text"):
            data, offs = text_buffers(b.column(c))
            lists = b.column(c + 1)
            at = lists.offsets.to_numpy()
            some = lists.is_valid().to_numpy(zero_copy_only=False)
            pos, kind = (lists.values.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("pos", "kind"))
            removed, spans, sha, kept = [], [], [], []
            for i in range(b.num_rows):
                text = data[offs[i] : offs[i + 1]]
                n = len(text)
                if some[i]:
                    p, k = pos[at[i] : at[i + 1]], kind[at[i] : at[i + 1]]
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.clip(np.where(k == COVERED, p - LEFT, p), 0, n), 1)
                    np.add.at(edge, np.minimum(p + WIDTH, n), -1)
                    gone = np.cumsum(edge[:n]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(n > 0 and gone[0]))
                    text = text[~gone]
                else:
                    removed.append(0)
                    spans.append(0)
                raw = text.tobytes()
                sha.append(hashlib.sha256(raw).hexdigest())
                kept.append(raw)
            cols = [b.column(j) for j in range(c)] + [pa.array(np.diff(offs), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            names = [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names)

    types = dict(src.dtypes)
    schema = ", ".join(f"`{x}` {types[x]}" for x in keep) + ", n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    return src.mapInArrow(run, schema)
