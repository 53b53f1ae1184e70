"""From bands to components: which candidates are compared, and in what order.

Band keys travel as packed arrays, cut by ranges of the key.  A task first
resolves its own equal keys: of the members that it has of a bucket only the
smallest goes on, so a bucket that holds a third of all rows arrives as one
entry per task.  Each member of a bucket gets a hub (the smallest member that
its task or its range knows of); pairs of member and hub are confirmed, and
components are formed from the links.

Members of a bucket that are then still in different components are compared
with each other as well: the exact sets come into one task, small buckets many
at a time and large ones block against block, and only as many links leave it
as it takes to join components.  So a pair that shares a bucket is either
confirmed, refuted or inside one component, and no refuted pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import collect_garbage, pack, partitions, ragged, release, runs, staged, unpack, unstage
from .components import components

#: Entries (key, vertex) that a task resolves and packs at once.
FLUSH = 600_000
#: Low bits of a key that are left out, so that a vertex's place has room there (2**16 vertices a flush at most).
DROPPED_BITS = 16
#: Members, and bytes of their sets, of a block of a large bucket; bytes that small buckets are gathered to.
BLOCK, BLOCK_BYTES, GROUP_BYTES = 1024, 4 << 20, 1 << 20
#: Shingles that so few members share are counted pair by pair, others by a matrix product.
FEW = 12
#: Members of a bucket up to which its pairs are compared one by one, together with those of other buckets.
SMALL = 32

#: Band keys (a row per vertex, a column per band) and the vertices of batches, and packs that ride along (part, bytes).
Signed = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, bytes]]]]]
#: Distinct shingle hashes of a column of sets, and their offsets.
Load = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def _spread(keys: list[np.ndarray], vs: list[np.ndarray], parts: int) -> pa.RecordBatch:
    keys, v = np.concatenate(keys), np.concatenate(vs)
    _, once = np.unique(keys[:, 0] + v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)  # a vertex that came twice has the same keys
    keys, v = keys[once], v[once]
    # sorted as one number: a key without its last bits, and there the vertex's place
    bits = np.uint64(max(1, (len(v) - 1).bit_length()))
    key = np.sort(((keys >> bits << bits) | np.arange(len(v), dtype=np.uint64)[:, None]).ravel())
    v = v[(key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]
    key = key >> np.uint64(DROPPED_BITS) << np.uint64(DROPPED_BITS)
    begin = np.flatnonzero(runs(key))
    ends = np.append(begin, len(key))
    at, size = ragged(ends, np.flatnonzero(np.diff(ends) > 1))  # most keys are one vertex's alone
    hub = np.repeat(np.minimum.reduceat(v[at], np.cumsum(size) - size), size) if len(at) else v[at]
    far = v[at] != hub
    rest, hub = at[far], hub[far]
    out = []
    if len(rest):  # known to have a mate; sent to be written, not to be compared
        out.append((-1 - int(key[0] % np.uint64(parts)), pack(key[rest].view(np.int64), v[rest], hub)))
    held, left = np.zeros(len(key), np.uint8), np.ones(len(key), bool)
    held[at] = 1
    left[rest] = False
    left = np.flatnonzero(left)
    key, v, held = key[left], v[left], held[left]
    part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange(parts + 1))
    key >>= np.uint64(DROPPED_BITS)
    for p in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[p], cuts[p + 1])
        out.append((int(p), pack(np.diff(key[s], prepend=np.uint64(0)), v[s], held[s])))
    return pa.RecordBatch.from_arrays([pa.array([False] * len(out)), pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["rides", "part", "pack"])


MATES = "bucket bigint, v bigint, hub bigint, part int, pack binary"


def _meet(t: pa.Table) -> pa.Table:
    """``bucket, v, hub`` of one range of keys; of a bucket of two only the pair, without ``bucket``; what rides along as it is."""
    part, packs = t["part"][0].as_py(), t["pack"].to_pylist()
    if t["rides"][0].as_py():
        n = len(packs)
        none = pa.nulls(n, pa.int64())
        return pa.table({"bucket": none, "v": none, "hub": none, "part": pa.array([part] * n, pa.int32()), "pack": pa.array(packs, pa.binary())})
    if part < 0:
        key, v, hub = (np.concatenate(x) for x in zip(*(unpack(p, np.int64, np.int64, np.int64) for p in packs), strict=True))
        pair = np.zeros(len(key), bool)
    else:
        keys, vs, helds = [], [], []
        for p in packs:
            k, v, h = unpack(p, np.uint64, np.int64, np.uint8)
            keys.append(np.cumsum(k, dtype=np.uint64) << np.uint64(DROPPED_BITS))
            vs.append(v)
            helds.append(h)
        key, v, held = np.concatenate(keys), np.concatenate(vs), np.concatenate(helds) > 0
        order = np.argsort(key, kind="stable")
        key, held = key[order], held[order]
        same = key[1:] == key[:-1]
        some = held.copy()
        some[1:] |= same
        some[:-1] |= same
        key, v, held = key[some], v[order[some]], held[some]  # most keys are one vertex's alone
        order = np.lexsort((v, key))
        key, v, held = key[order], v[order], held[order]
        once = np.flatnonzero(runs(key, v))  # a vertex may have been signed by several tasks
        held = np.logical_or.reduceat(held, once) if len(once) else held
        key, v = key[once], v[once]
        begin = np.flatnonzero(runs(key))
        size = np.diff(np.append(begin, len(key)))
        hub, held = np.repeat(v[begin], size), np.repeat(np.logical_or.reduceat(held, begin), size) if len(begin) else held
        size = np.repeat(size, size)
        pair = (size == 2) & ~held
        shared = ((size > 1) | held) & ~(pair & (v == hub))
        key, v, hub, pair = key[shared].view(np.int64), v[shared], hub[shared], pair[shared]
    n = len(key)
    return pa.table({"bucket": pa.array(key, pa.int64(), mask=pair), "v": pa.array(v, pa.int64()), "hub": pa.array(hub, pa.int64()), "part": pa.nulls(n, pa.int32()), "pack": pa.nulls(n, pa.binary())})


def bucket_mates(rows: DataFrame, signed: Signed) -> DataFrame:
    """``bucket, v, hub`` of the buckets that two vertices or more share, without ``bucket`` where they are two.

    ``signed`` turns batches of ``rows`` into band keys and vertices; a vertex
    may come more than once.  Packs that ride along come back as rows ``part,
    pack``, without the other columns.
    """
    parts = 4 * partitions(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks, vs, n = [], [], 0
        for k, v, extra in signed(batches):
            if extra:
                yield pa.RecordBatch.from_arrays([pa.array([True] * len(extra)), pa.array([p for p, _ in extra], pa.int32()), pa.array([x for _, x in extra], pa.binary())], ["rides", "part", "pack"])
            if not len(v):
                continue
            ks.append(k)
            vs.append(v)
            n += k.size
            if n >= FLUSH or sum(map(len, vs)) >= 1 << (DROPPED_BITS - 1):
                yield _spread(ks, vs, parts)
                ks, vs, n = [], [], 0
        if n:
            yield _spread(ks, vs, parts)
        ks = vs = None
        release()

    packed = rows.mapInArrow(run, "rides boolean, part int, pack binary")
    return staged(packed.groupBy("rides", "part").applyInArrow(_meet, MATES), "cluster-mates")


def pair_counts(flat: np.ndarray, offs: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many hashes the sets ``x[k]`` and ``y[k]`` share, each set's hashes being distinct."""
    out = np.zeros(len(x), np.int64)
    size = offs[x + 1] - offs[x] + offs[y + 1] - offs[y]
    ends = np.cumsum(size)
    at = 0
    while at < len(x):  # at most 2**14 pairs, and about a million hashes, at once
        base = ends[at - 1] if at else 0
        end = min(len(x), at + (1 << 14), max(at + 1, int(np.searchsorted(ends, base + (1 << 20)))))
        keys = []
        for side in (x[at:end], y[at:end]):
            pos, lens = ragged(offs, side)
            keys.append((np.repeat(np.arange(end - at, dtype=np.uint64), lens) << np.uint64(50)) | (flat[pos] >> np.uint64(14)))
        k = np.sort(np.concatenate(keys))
        out[at:end] = np.bincount((k[1:][k[1:] == k[:-1]] >> np.uint64(50)).astype(np.int64), minlength=end - at)
        at = end
    return out


def _pairs_of(order: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows inside each of the small buckets."""
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in np.unique(size):
        rows = order[begin[size == n][:, None] + np.arange(n)]
        one, two = np.triu_indices(n, 1)
        xs.append(rows[:, one].ravel())
        ys.append(rows[:, two].ravel())
    return np.concatenate(xs), np.concatenate(ys)


def vertices_of(mates: DataFrame) -> DataFrame:
    """``v`` of all vertices in ``mates``."""
    return mates.select(F.explode(F.array("v", "hub")).alias("v")).distinct()


def common_counts(flat: np.ndarray, offs: np.ndarray, rows: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many hashes the sets ``rows`` share with the sets ``other``: a matrix, not valid where a set meets itself."""
    both = np.union1d(rows, other)
    n = len(both)
    at, lens = ragged(offs, both)
    row = np.repeat(np.arange(n), lens)
    _, col, df = np.unique(flat[at], return_inverse=True, return_counts=True)
    order = np.argsort(col, kind="stable")
    order = order[df[col[order]] > 1]  # a hash of one set is in no intersection
    row, df = row[order], df[df > 1]
    first = np.cumsum(df) - df
    cells = []
    for d in np.unique(df[df <= FEW]):
        r = row[first[df == d][:, None] + np.arange(d)]
        for i in range(int(d)):
            for j in range(i + 1, int(d)):
                cells += [r[:, i] * n + r[:, j], r[:, j] * n + r[:, i]]
    cell = np.concatenate(cells) if cells else np.zeros(0, np.int64)
    x, y = np.searchsorted(both, rows), np.searchsorted(both, other)
    out = np.bincount(cell, minlength=n * n).reshape(n, n)[x][:, y].astype(np.float32)
    many = np.flatnonzero(df > FEW)
    for lo in range(0, len(many), 4096):
        cols = many[lo : lo + 4096]
        has = np.zeros((n, len(cols)), np.float32)
        has[row[np.concatenate([np.arange(first[c], first[c] + df[c]) for c in cols])], np.repeat(np.arange(len(cols)), df[cols])] = 1
        out += has[x] @ has[y].T
    return out


def spanning_links(t: pa.Table, load: Load, percent: int) -> pa.Table:
    """``a, b``: links that join the components of buckets: ``bucket, i, j, own, v, hub, label, items``.

    ``items`` may be null in all rows of a member but one.

    All pairs of the two blocks ``i`` and ``j`` of a bucket (one bucket after the
    other) are compared exactly; of those that are similar only as many are
    returned as it takes to join their components.
    """
    t = t.combine_chunks()
    v, hub, label, own, i, j, bucket = (t[c].to_numpy() for c in ("v", "hub", "label", "own", "i", "j", "bucket"))
    _, row = np.unique(v, return_inverse=True)
    held = np.flatnonzero(t["items"].is_valid().to_numpy())
    first = held[np.unique(v[held], return_index=True)[1]]  # a member of many buckets is sent and read once
    items = t["items"].take(pa.array(first))
    flat, offs = load(items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items)
    size = np.diff(offs)
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.get(k, k)) != k:
            root[k] = root.get(up, up)
            k = up
        return k

    out = []

    def link(p: np.ndarray, q: np.ndarray) -> None:
        for a, b in zip(p.tolist(), q.tolist(), strict=True):
            one, two = find(int(label[a])), find(int(label[b]))
            if one != two:
                root[max(one, two)] = min(one, two)
                out.append((min(v[a], v[b]), max(v[a], v[b])))

    order = np.argsort(bucket, kind="stable")
    begin = np.flatnonzero(runs(bucket[order]))
    n = np.diff(np.append(begin, len(order)))
    small = (n <= SMALL) & (i[order[begin]] == j[order[begin]])
    x, y = _pairs_of(order, begin[small], n[small])
    apart = (label[x] != label[y]) & (v[x] != hub[y]) & (hub[x] != v[y])  # pairs with a hub are refuted already
    x, y = x[apart], y[apart]
    _, once = np.unique(np.minimum(row[x], row[y]) * len(first) + np.maximum(row[x], row[y]), return_index=True)
    x, y = x[once], y[once]
    fits = 100 * np.minimum(size[row[x]], size[row[y]]) >= percent * np.maximum(size[row[x]], size[row[y]])  # the intersection is no larger than either set
    x, y = x[fits], y[fits]
    both = pair_counts(flat, offs, row[x], row[y])
    near = (both > 0) & (100 * both >= percent * (size[row[x]] + size[row[y]] - both))
    link(x[near], y[near])
    for lo, hi in zip(begin[~small], (begin + n)[~small], strict=True):
        rows = order[lo:hi]
        left, right = rows[own[rows] == i[rows[0]]], rows[own[rows] == j[rows[0]]]
        if not len(left) or not len(right) or label[rows].min() == label[rows].max():
            continue
        both = common_counts(flat, offs, row[left], row[right])
        union = size[row[left]][:, None] + size[row[right]][None, :] - both
        x, y = np.nonzero((both > 0) & (100 * both >= percent * union) & (label[left][:, None] != label[right][None, :]))
        link(left[x], right[y])
    del flat, items, t
    release()
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _labelled(df: DataFrame, label: DataFrame, col: str, name: str) -> DataFrame:
    return df.join(label.select(F.col("v").alias(col), F.col("label").alias(name)), col, "left").withColumn(name, F.coalesce(name, col))


def cluster(mates: DataFrame, confirm: Callable[[DataFrame], DataFrame], sets: DataFrame, load: Load, percent: int) -> DataFrame:
    """``v, label`` of the vertices with a link.

    ``mates``: ``bucket, v, hub``.  ``confirm`` keeps the true links of pairs
    ``a, b``.  ``sets``: ``v, items`` (what ``load`` reads) of all vertices in ``mates``.
    """
    spark = mates.sparkSession
    stars = mates.where(F.col("v") != F.col("hub")).select("bucket", "v", "hub")

    def torn(rows: DataFrame) -> DataFrame:
        """Rows whose member and hub are in different components."""
        return _labelled(_labelled(rows, label, "v", "la"), label, "hub", "lb").where(F.col("la") != F.col("lb")).select("bucket", "v", "hub")

    # each vertex first with the smallest of its hubs, then with the others outside its component
    first = staged(stars.groupBy(F.col("v").alias("a")).agg(F.min("hub").alias("b")), "cluster-first")
    links = staged(confirm(first), "cluster-links")
    label = components(links)
    left = staged(torn(stars), "cluster-torn")
    apart = left.select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    more = staged(confirm(apart), "cluster-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        unstage(label)
        label = components(links)
    collect_garbage(spark)

    # rows tie all members of a bucket to each other, so it holds several components if and only if one of them is torn
    mixed = torn(left.where(F.col("bucket").isNotNull())).select("bucket").distinct()
    members = mates.join(mixed, "bucket").groupBy("bucket", "v").agg(F.min("hub").alias("hub"))
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("hub").alias("least")).where(F.col("n") > 2)
    members = staged(_labelled(members.join(counts, "bucket"), label, "v", "label"), "cluster-mixed")
    if not members.isEmpty():
        # placed by the sizes of sets alone; the sets themselves are shuffled last, to each task once
        sized = staged(members.join(sets.groupBy("v").agg(F.max(F.octet_length("items")).alias("bytes")), "v"), "cluster-sized")
        weight = sized.groupBy("bucket").agg(F.sum("bytes").alias("total"))
        blocks = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.ceil(F.col("total") / F.lit(BLOCK_BYTES))).cast("int")
        groups = 1 + int((weight.agg(F.sum("total")).head()[0] or 0) // GROUP_BYTES)
        placed = (
            sized.join(weight, "bucket")
            .withColumn("blocks", blocks)
            .withColumn("own", F.pmod(F.hash("v"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            # a bucket of one block shares its task with others, first of all with those of its smallest member, which have
            # the same pairs again; of a larger one each pair of blocks has its own
            .withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.hash("least"), F.lit(groups)).cast("bigint")).otherwise(F.col("bucket")))
            .select("task", "blocks", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "v", "hub", "label")
        )
        again = F.row_number().over(Window.partitionBy("v", "task", "blocks", "i", "j").orderBy("bucket"))
        placed = staged(placed.withColumn("again", again), "cluster-placed")
        rows = placed.join(sets, "v").select("task", "blocks", "bucket", "i", "j", "own", "v", "hub", "label", F.when(F.col("again") == 1, F.col("items")).alias("items"))
        more = staged(rows.groupBy("task", "blocks", "i", "j").applyInArrow(lambda t: spanning_links(t, load, percent), "a bigint, b bigint"), "cluster-links")
        unstage(sized, placed)
        if not more.isEmpty():
            unstage(label)
            label = components(links.unionByName(more))
    unstage(members, left, first)
    return label
