"""Sharding by vector bin packing (operator 10).

Groups (equal texts) have three sizes: bytes, tokens (words) and rows.  Each
group goes, whole, to the shard where the dot product of its sizes with the
shard's residual capacity is highest, among those that have room for it; only a
group larger than a shard is cut.  Law ``bytes``: the shards' bytes come out
near equal, rows and tokens are balanced with them.

1. Groups that are a noticeable part of a shard are placed first, on the driver:
   there are at most ``3 * shards / LARGE`` of them whatever the input.
2. All others are dealt by hash into parts.  A part places its groups, each by
   its dot product, into its share of what is left of every shard, then evens
   rows by moves and bytes by swaps of groups with as many rows.
3. Slots are counted inside groups (inside salted pieces of large ones), from
   where the group begins in its part and the part in its shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, unstage

#: Share of a shard, in any size, from which a group is placed on the driver.
LARGE = 1 / 64
#: Groups of a part, and the most parts.
PART_GROUPS, PARTS = 2048, 8192
#: Rows of a large group that are numbered in one task.
PIECE_ROWS = 65_536


def pack(sizes: np.ndarray, capacity: np.ndarray, turn: int = 0) -> np.ndarray:
    """Shard of each item, items in falling order of their largest share.

    ``sizes`` has a row per item, ``capacity`` one per shard, both a column per
    resource.  Where no shard has room for an item all may take it.  Ties go to
    the first shard from ``turn`` on.
    """
    total = np.maximum(capacity.sum(0), 1e-9)
    item = sizes / total
    residual = np.roll(capacity / total, -turn, 0)
    shards = len(residual)
    out = np.zeros(len(sizes), np.int64)
    for k in np.lexsort((np.arange(len(sizes)), -item[:, 0], -item.max(1, initial=0))):
        dots = residual @ item[k]
        room = (residual >= item[k] - 1e-12).all(1)
        at = int(np.argmax(np.where(room, dots, -np.inf) if room.any() else dots))
        out[k] = (at + turn) % shards
        residual[at] -= item[k]
    return out


def even(sizes: np.ndarray, where: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """Narrow the differences of a packing: rows (last size) by moves, then bytes (first) by swaps that keep rows."""
    where = where.copy()
    shards = len(capacity)
    over = np.stack([np.bincount(where, sizes[:, k], shards) for k in range(sizes.shape[1])], 1) - capacity
    last = sizes.shape[1] - 1

    def put(k: int, to: int) -> None:
        over[where[k]] -= sizes[k]
        over[to] += sizes[k]
        where[k] = to

    for _ in range(len(sizes)):
        hi, lo = int(over[:, last].argmax()), int(over[:, last].argmin())
        mine = np.flatnonzero(where == hi)
        mine = mine[(sizes[mine, last] < over[hi, last] - over[lo, last]) & (sizes[mine, last] > 0)]
        if over[hi, last] - over[lo, last] < 1.5 or not len(mine):
            break
        put(int(mine[np.abs(sizes[mine, 0] - (over[hi, 0] - over[lo, 0]) / 2).argmin()]), lo)
    stuck: set[tuple[int, int]] = set()
    for _ in range(64 * shards):
        order = np.argsort(over[:, 0], kind="stable")
        pairs = [(int(order[-1 - i]), int(order[j])) for i in range(3) for j in range(3)] if shards > 5 else [(int(order[-1]), int(order[0]))]
        hi, lo = next((p for p in pairs if p not in stuck), (-1, -1))
        gap = over[hi, 0] - over[lo, 0]
        if hi < 0 or gap <= 1:
            break
        a, b = np.flatnonzero(where == hi), np.flatnonzero(where == lo)
        best = (np.inf, -1, -1)
        for n in np.intersect1d(sizes[a, last], sizes[b, last]):
            x, y = a[sizes[a, last] == n], b[sizes[b, last] == n]
            y = y[np.argsort(sizes[y, 0], kind="stable")]
            at = np.searchsorted(sizes[y, 0], sizes[x, 0] - gap / 2)
            for c in (np.maximum(at - 1, 0), np.minimum(at, len(y) - 1)):
                d = sizes[x, 0] - sizes[y[c], 0]
                off = np.where((d > 0) & (d < gap), np.abs(d - gap / 2), np.inf)
                k = int(off.argmin())
                if off[k] < best[0]:
                    best = (float(off[k]), int(x[k]), int(y[c[k]]))
        if best[1] < 0:
            stuck.add((hi, lo))
            continue
        stuck = {p for p in stuck if hi not in p and lo not in p}
        put(best[1], lo)
        put(best[2], hi)
    return where


def _large(rows: DataFrame, groups: DataFrame, total: np.ndarray, shards: int) -> tuple[list, np.ndarray]:
    """Plan of the large groups (``group, pieces, salt, shard, first``) and what they take of each shard."""
    spark = rows.sparkSession
    floor = [max(1.0, t / shards * LARGE) for t in total.tolist()]
    # bounded: a size is the sum of its groups
    found = groups.where((F.col("bytes") >= floor[0]) | (F.col("tokens") >= floor[1]) | (F.col("rows") >= floor[2])).collect()
    if not found:
        return [], np.zeros((shards, 3))
    pieces, whole = {}, set()
    for r in found:
        share = max(r["bytes"] / max(total[0], 1), r["tokens"] / max(total[1], 1), r["rows"] / max(total[2], 1))
        pieces[r["group"]] = -(-r["rows"] // PIECE_ROWS)
        if share * shards > 1 and r["rows"] > 1:  # no shard has room: pieces of half a shard
            pieces[r["group"]] = max(pieces[r["group"]], min(r["rows"], int(np.ceil(2 * shards * share))))
        else:
            whole.add(r["group"])
    cut = [(g, n) for g, n in pieces.items() if n > 1]
    units = [(r["group"], 0, r["bytes"], r["tokens"], r["rows"]) for r in found if pieces[r["group"]] == 1]
    if cut:
        salted = rows.join(F.broadcast(spark.createDataFrame(cut, "group bigint, pieces int")), "group").withColumn("salt", _salt())
        units += [tuple(r) for r in salted.groupBy("group", "salt").agg(F.sum("size"), F.sum("words"), F.count(F.lit(1))).collect()]
    units.sort()
    sizes = np.array([u[2:] for u in units], np.int64).reshape(-1, 3)
    # items: whole groups, and the pieces of those that are cut
    names = [(u[0], -1) if u[0] in whole else (u[0], u[1]) for u in units]
    index = {n: k for k, n in enumerate(dict.fromkeys(names))}
    item = np.array([index[n] for n in names])
    weight = np.zeros((len(index), 3), np.int64)
    np.add.at(weight, item, sizes)
    capacity = np.tile(total / shards, (shards, 1))
    where = pack(weight, capacity)
    if (weight.sum(0) == total).all():
        where = even(weight, where, capacity)
    filled, plan = np.zeros((shards, 3), np.int64), []
    for u, k in zip(units, item.tolist(), strict=True):
        plan.append((u[0], pieces[u[0]], u[1], int(where[k]), int(filled[where[k], 2])))
        filled[where[k]] += np.array(u[2:], np.int64)
    return plan, filled


def _salt():
    return F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int")


def _part(t: pa.Table, left: np.ndarray, turn: int) -> pa.Table:
    """``part, group, shard, first, rows``: the groups of one part placed in its share of the shards."""
    t = t.combine_chunks()
    group, part = t["group"].to_numpy(), t["part"].to_numpy()
    sizes = np.stack([t[c].to_numpy() for c in ("bytes", "tokens", "rows")], 1).astype(np.int64)
    order = np.argsort(group, kind="stable")
    group, sizes = group[order], sizes[order]
    capacity = left / np.maximum(left.sum(0), 1e-9) * sizes.sum(0)
    where = even(sizes, pack(sizes, capacity, turn), capacity)
    by = np.argsort(where, kind="stable")
    n = sizes[by, 2]
    before = np.cumsum(n) - n
    begins = np.searchsorted(where[by], np.arange(len(left)))
    start = np.append(before, n.sum())[begins]
    first = np.empty(len(n), np.int64)
    first[by] = before - start[where[by]]
    return pa.table({"part": pa.array(part, pa.int32()), "group": pa.array(group), "shard": pa.array(where.astype(np.int32)), "first": pa.array(first), "rows": pa.array(sizes[:, 2])})


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Null text counts as empty (size 8, crc 0) and groups with empty texts;
    repeated rows are rows of their own, in any order among themselves; groups
    of equal size are taken in order of their hash; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).cast("bigint").alias("words"),
    )
    rows = staged(rows, "packing-rows")  # the texts are read once; what follows sees a few numbers a row
    groups = staged(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.sum("words").alias("tokens"), F.count(F.lit(1)).alias("rows")), "packing-groups")
    t = groups.agg(F.sum("bytes"), F.sum("tokens"), F.sum("rows"), F.count(F.lit(1))).head()
    total, n_groups = np.array([x or 0 for x in t[:3]], float), t[3]
    plan, filled = _large(rows, groups, total, shards)
    planned = spark.createDataFrame(plan, "group bigint, pieces int, salt int, shard int, first bigint")
    pieces = F.broadcast(planned.select("group", "pieces").distinct())  # bounded, as is the plan: by 3 * shards / LARGE groups and their pieces

    left = np.maximum(total / shards - filled, 0)
    parts = max(1, min(PARTS, -(-n_groups // PART_GROUPS)))
    small = groups.join(pieces, "group", "left_anti").withColumn("part", F.pmod(F.hash("group"), F.lit(parts)).cast("int"))
    placed = staged(small.groupBy("part").applyInArrow(lambda p: _part(p, left, p["part"][0].as_py() % shards), "part int, group bigint, shard int, first bigint, rows bigint"), "packing-placed")
    # where a part begins in a shard: at most PARTS * shards rows
    sums = placed.groupBy("part", "shard").agg(F.sum("rows").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.element_at(F.array(*[F.lit(int(n)) for n in filled[:, 2]]), F.col("shard") + 1)
    sums = sums.select("part", "shard", (before + taken).alias("before"))
    placed_at = placed.join(F.broadcast(sums), ["part", "shard"]).select("group", "shard", (F.col("first") + F.col("before")).alias("first"))

    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("doc_id", "size"))
    few = rows.join(pieces, "group", "left_anti").join(placed_at, "group").withColumn("nth", nth("group"))
    many = rows.join(pieces, "group").withColumn("salt", _salt()).withColumn("nth", nth("group", "salt")).join(F.broadcast(planned.drop("pieces")), ["group", "salt"])
    columns = ["doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
    out = staged(few.select(*columns).unionByName(many.select(*columns)), "packing-out")
    unstage(rows, groups, placed)
    return out
