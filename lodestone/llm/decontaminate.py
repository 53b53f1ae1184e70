"""Benchmark decontamination by a prefix-filtered set join (operator 4, native).

An item's windows are its runs of ``width`` words (a shorter item is one
window).  A window can only occur where all its words occur, so one necessary
word is enough as its prefix: the rarest by its count over all documents.  It
is joined together with the word that has to stand beside it, so a hit at
position *i* of a pair with offset *o* in its window leaves one possible start,
*i - o*, which has to lie inside the document (positional and length bound)
before the window's words are compared with the document's, one by one.

Everything is DataFrame functions.  Documents are read twice (word counts, then
the probe) and never shuffled; what leaves them are the places that a Bloom
filter over the prefixes lets through.  Filters are arrays of at most
``FILTER_BITS`` bits whatever the benchmark's size; nothing else is collected,
and no join is forced to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of a filter for each key, and in all; beyond that it lets more through, and the result is the same.
KEY_BITS, FILTER_BITS = 32, 1 << 23


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN)
    return F.array_remove(parts, "")  # a separator at an end leaves an empty part


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """``wid, window, item``: the windows of every item, each once an item."""
    n = F.size("ws")
    wide = F.least(n, F.lit(width))
    starts = F.sequence(F.lit(1), n - wide + 1)
    return (
        items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws"))
        .where(F.size("ws") > 0)
        .select("item", F.explode(F.array_distinct(F.transform(starts, lambda s: F.slice("ws", s, wide)))).alias("window"))
        .select(F.sha2(F.array_join("window", " "), 256).alias("wid"), "window", "item")
    )


def bloom_filter(keys: DataFrame) -> Callable[[Column], Column]:
    """A test for keys (``key``, a long) that are possibly among the given ones."""
    bits = 1024
    n = keys.count()
    while bits < min(FILTER_BITS, KEY_BITS * n):
        bits *= 2

    def places(key: Column) -> list[tuple[Column, Column]]:
        return [(F.shiftrightunsigned(h, 6).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")) for h in (F.shiftrightunsigned(key, k).bitwiseAND(F.lit(bits - 1)) for k in (0, 32))]

    both = [keys.select(slot.alias("slot"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bit")) for slot, bit in places(F.col("key"))]
    found = dict(both[0].unionByName(both[1]).groupBy("slot").agg(F.bit_or("bit")).collect())  # bits / 64 rows at most
    table = F.split(F.lit(",".join(str(found.get(k, 0)) for k in range(bits // 64))), ",").cast("array<bigint>")  # folded to one literal

    def test(key: Column) -> Column:
        (slot, bit), (slot2, bit2) = places(key)
        return (F.getbit(F.get(table, slot), bit) == 1) & (F.getbit(F.get(table, slot2), bit2) == 1)

    return test


def _pair(ws: Column, i: Column) -> Column:
    """Key of the words at ``i`` and after it; of one word if it is the last."""
    return F.xxhash64(F.get(ws, i), F.get(ws, i + 1))


def prefixes(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``wid, window, size, off, key``: distinct windows that can occur, and where their rarest pair is."""
    distinct = windows.select("wid", "window").dropDuplicates(["wid"])
    each = distinct.select("wid", "window", F.posexplode("window").alias("off", "w"))
    seen = bloom_filter(each.select(F.xxhash64("w").alias("key")).distinct())
    ws = words(F.col("text"))
    counts = docs.select(F.explode(F.array_distinct(F.filter(ws, lambda w: seen(F.xxhash64(w))))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    # a window with a word that no document has cannot occur: the inner join drops that word, the size shows it
    rarest = each.join(counts, "w").groupBy("wid", "window").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("df", "w", "off")).alias("rarest")).where(F.col("found") == F.size("window"))
    size = F.size("window")
    off = F.greatest(F.least(F.col("rarest.off"), size - 2), F.lit(0))
    return rarest.select("wid", "window", size.alias("size"), off.alias("off")).withColumn("key", _pair(F.col("window"), F.col("off")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, full``.

    ``contaminated``: ``n_hit > 0 and share * n_hit >= n_words``; ``full``: a
    window of ``width`` words occurs.  Null text has no words; items without
    words match nothing, items with equal text all count; repeated rows are
    judged alike, a row each; an empty table on either side gives no hit.
    """
    windows = staged(windows_of(benchmark, width), "decontaminate-windows")
    ranked = staged(prefixes(docs, windows), "decontaminate-prefixes")
    pair = bloom_filter(ranked.where(F.col("size") > 1).select("key").distinct())
    lone = ranked.where(F.col("size") == 1).select("key").distinct()
    single = bloom_filter(lone) if not lone.isEmpty() else None
    reach = width - 1

    def probe(w: Column, i: Column) -> Column:
        key = _pair(F.col("ws"), i)
        hit = lambda test, k: F.when(test(k), F.struct(i.alias("i"), k.alias("key"), F.least(i, F.lit(reach)).alias("lead"), F.slice("ws", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * width - 1)).alias("context")))
        one = F.array(hit(pair, key))
        return F.concat(one, F.array(hit(single, F.xxhash64(w, F.lit(None).cast("string"))))) if single is not None else one

    text = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("ws"))
    near = F.filter(F.flatten(F.transform("ws", probe)), lambda p: p.isNotNull())
    probed = staged(text.select("doc_id", "h", F.size("ws").cast("bigint").alias("n_words"), near.alias("near")), "decontaminate-probed")
    begins = F.col("p.lead") - F.col("off")
    fits = (begins >= 0) & (F.slice("p.context", F.greatest(begins, F.lit(0)) + 1, F.col("size")) == F.col("window"))
    hits = (
        probed.select("doc_id", "h", F.explode("near").alias("p"))
        .select("doc_id", "h", "p", F.col("p.key").alias("key"))
        .join(ranked, "key")
        .where(fits)
        .groupBy("doc_id", "h")
        .agg(F.collect_set(F.struct((F.col("p.i") - F.col("off")).alias("start"), "size")).alias("spans"), F.array_sort(F.collect_set("wid")).alias("wids"))
    )
    span = F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))
    hits = staged(hits.select("doc_id", "h", F.size(F.array_distinct(F.flatten(span))).cast("bigint").alias("n_hit"), F.exists("spans", lambda s: s["size"] == width).alias("full"), "wids"), "decontaminate-hits")
    # items are looked up once for each set of windows, however many documents have it
    items = (
        hits.select("wids").distinct().select("wids", F.explode("wids").alias("wid")).join(windows.select("wid", "item"), "wid")
        .groupBy("wids").agg(F.array_sort(F.collect_set("item")).alias("names"))
        .select("wids", F.size("names").cast("bigint").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"))
    )
    found = hits.join(items, "wids").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "n_hit", "n_items", "items_sha256", "full")
    base = probed.select("doc_id", "h", "n_words")
    out = base.join(found, base["doc_id"].eqNullSafe(found["__id"]) & (base["h"] == found["__h"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    out = staged(
        out.select(
            "doc_id",
            F.col("h").alias("text_hash"),
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
            F.coalesce("full", F.lit(False)).alias("full"),
        ),
        "decontaminate-out",
    )
    unstage(windows, ranked, probed, hits)
    return out
