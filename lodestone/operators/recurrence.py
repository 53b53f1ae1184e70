"""Recurring asks: greedy first-fit grouping by token overlap.

In order of time an ask joins the first group whose founding ask it resembles
(Jaccard of token sets), else it founds one.  Equal token sets meet the same
fate, so each set is looked at once; candidates come from signatures compared
block by block, and founders are settled in rounds: an ask is a founder as
soon as all earlier look-alikes are known not to be.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import is_noise
from ..functions.text import ascii_lower, squeeze, text_of
from ..plans.staging import staged

MIN_TOKENS, PERCENT = 5, 60
#: Sizes of a band differ by this factor; rows and bytes of a block; rows compared at once; rows of an Arrow batch and of a task.
RATIO, BLOCK, BLOCK_BYTES, TILE, COPIES, TASK_ROWS = 1.25, 1 << 15, 16 << 20, (128, 4096), 1 << 14, 20_000
# Fixed value: how a recurring ask is printed (number of sessions, first day, first words).
LINE = "carried across {} sessions since {}: {}"


def ask_tokens(c: Column | str) -> Column:
    """Distinct lower-case runs of two or more ASCII letters and digits, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(ascii_lower(text_of(c)), F.lit("([a-z0-9]{2,})"), F.lit(1))))


def _signatures(batches: Iterator[pa.RecordBatch], partners: dict[tuple[int, int], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """``pair, side, num, n, sig`` from ``num, band, block, hashes``: a set goes to every pair of blocks that its own block is in."""
    for batch in batches:
        num, band, block, hashes = (batch.column(k) for k in range(4))
        n, flat, starts = np.diff(hashes.offsets.to_numpy()), hashes.flatten().to_numpy().view(np.uint64), hashes.offsets.to_numpy() - hashes.offsets[0].as_py()
        sigs = []
        for k, b in enumerate(band.to_numpy()):
            bits = _bits(b)
            odd = np.bincount((flat[starts[k] : starts[k + 1]] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
            sigs.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
        goes = [partners[key] for key in zip(band.to_pylist(), block.to_pylist(), strict=True)]
        at = np.repeat(np.arange(len(goes)), [len(x) for x in goes])
        to = np.array([y for x in goes for y in x], np.int64).reshape(-1, 2)
        sig = pa.array(sigs, pa.binary())
        for lo in range(0, len(at), COPIES):
            rows = at[lo : lo + COPIES]
            part = [pa.array(to[lo : lo + COPIES, 0]), pa.array(to[lo : lo + COPIES, 1]), num.take(pa.array(rows)), pa.array(n[rows].astype(np.int64)), sig.take(pa.array(rows))]
            yield pa.RecordBatch.from_arrays(part, ["pair", "side", "num", "n", "sig"])


def _side(table: pa.Table, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, sizes and signatures (rows of 64-bit words) of one block, by size."""
    part = table.filter(pc.equal(table["side"], side)).combine_chunks()
    num, n, sig = part["num"].to_numpy(), part["n"].to_numpy(), part["sig"].to_pylist()
    order = np.argsort(n, kind="stable")
    words = np.frombuffer(b"".join(sig), np.uint64).reshape(len(sig), -1) if sig else np.zeros((0, 1), np.uint64)
    return num[order], n[order], words[order]


def _fold(words: np.ndarray, most: int) -> np.ndarray:
    """Signatures of so many words: bits that fall together are added modulo 2."""
    while words.shape[1] > most:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """``a, b``: pairs of two blocks (or inside one) whose sizes and signatures allow the threshold.

    Sets that differ in ``d`` tokens differ in ``d`` bits of their signatures at
    most; a like pair of ``s`` tokens together differs in no more than ``(100 -
    percent) * s / (100 + percent)``.  A quarter of the bits settles most pairs.
    """
    num, n, sig = _side(table, 0)
    num2, n2, sig2 = _side(table, 1)
    alone = not len(num2)
    if alone:
        num2, n2, sig2 = num, n, sig
    found = []
    if len(num):
        width = min(sig.shape[1], sig2.shape[1])
        sig, sig2 = _fold(sig, width), _fold(sig2, width)
        first = max(1, width // 4)
        short, short2 = _fold(sig, first).T.copy(), _fold(sig2, first).T.copy()
        share = (100 - percent) / (100 + percent)
        for lo in range(0, len(num), TILE[0]):
            hi = min(lo + TILE[0], len(num))
            begin, end = np.searchsorted(n2, n[lo] * percent / 100 - 0.01), np.searchsorted(n2, n[hi - 1] * 100 / percent + 0.01, "right")
            for lo2 in range(max(begin, lo) if alone else begin, end, TILE[1]):
                hi2 = min(lo2 + TILE[1], end)
                apart = np.bitwise_count(short[0, lo:hi, None] ^ short2[0, None, lo2:hi2]).astype(np.uint16)
                for w in range(1, first):
                    apart += np.bitwise_count(short[w, lo:hi, None] ^ short2[w, None, lo2:hi2])
                most = (share * n[lo:hi]).astype(np.float32)[:, None] + (share * n2[lo2:hi2] + 0.01).astype(np.float32)[None, :]
                i, j = np.nonzero(apart <= most)
                i, j = i + lo, j + lo2
                keep = (100 * np.minimum(n[i], n2[j]) >= percent * np.maximum(n[i], n2[j])) & ((i < j) if alone else True)
                i, j = i[keep], j[keep]
                for k in range(0, len(i), COPIES):
                    x, y = i[k : k + COPIES], j[k : k + COPIES]
                    apart = np.bitwise_count(sig[x] ^ sig2[y]).sum(1, dtype=np.int64)
                    near = (100 + percent) * apart <= (100 - percent) * (n[x] + n2[y])
                    if near.any():
                        found.append((num[x[near]], num2[y[near]]))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
    return pa.table({"a": a, "b": b})


def _bits(band: int) -> int:
    """Bits of the signatures of a band: four or more for each token."""
    return 1 << max(8, min(14, math.ceil(math.log2(4 * RATIO ** (band + 1)))))


def similar_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b`` with ``a`` before ``b``: pairs of ``id, tokens`` whose Jaccard reaches ``percent``.

    Blocks of sets of like size are compared pair by pair inside tasks, by
    signatures: a bit for each residue of the tokens' hashes, set where an odd
    number of tokens has it.  No like pair is lost by them, and what they let
    pass is compared by its tokens.  What is shuffled are signatures, a copy for
    each pair of blocks, not the candidates; the comparisons grow with the square
    of the rows.
    """
    band = F.floor(F.log(F.size("tokens").cast("double")) / F.lit(math.log(RATIO))).cast("int")
    sets = staged(sets.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("num"), "id", "tokens", band.alias("band")), "like-sets")
    counts = {r[0]: r[1] for r in sets.groupBy("band").count().collect()}  # a row for each band of sizes
    cut = {b: -(-c // min(BLOCK, BLOCK_BYTES * 8 // _bits(b))) for b, c in counts.items()}
    blocks = [(b, k) for b in sorted(cut) for k in range(cut[b])]
    reach = int(math.log(100 / percent) / math.log(RATIO)) + 1
    partners: dict[tuple[int, int], list[tuple[int, int]]] = {x: [] for x in blocks}
    pair = copies = 0
    for i, x in enumerate(blocks):
        for y in blocks[i:]:
            if y[0] - x[0] > reach:
                break
            partners[x].append((pair, 0))
            if y != x:
                partners[y].append((pair, 1))
            copies += counts[x[0]] // cut[x[0]] + counts[y[0]] // cut[y[0]]
            pair += 1
    of_band = F.element_at(F.create_map(*[F.lit(v) for b, c in (cut or {0: 1}).items() for v in (b, c)]), F.col("band"))
    dealt = sets.select("num", "band", F.pmod(F.xxhash64("num"), of_band).cast("int").alias("block"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    signed = dealt.mapInArrow(lambda batches: _signatures(batches, partners), "pair bigint, side bigint, num bigint, n bigint, sig binary")
    parts = max(1, min(pair, -(-copies // TASK_ROWS)))
    near = signed.repartition(parts, "pair").groupBy("pair").applyInArrow(lambda t: _compare(t, percent), "a bigint, b bigint")
    near = staged(near, "like-pairs")
    left, right = sets.select(F.col("num").alias("a"), F.col("id").alias("ia"), F.col("tokens").alias("ta")), sets.select(F.col("num").alias("b"), F.col("id").alias("ib"), F.col("tokens").alias("tb"))
    both = near.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(100 * common >= percent * (F.size("ta") + F.size("tb") - common)).select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


def group_asks(asks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``rowid, founder``: the group of every ask (``rowid, text, session, ts``) of five tokens or more.

    Order is ``ts``, then ``rowid``; ``founder`` is the founding ask's ``rowid``.
    """
    toks = asks.select("rowid", text_of("ts").alias("ts"), ask_tokens("text").alias("tokens")).where(F.size("tokens") >= MIN_TOKENS)
    id_ = F.min(F.struct("ts", "rowid")).alias("id")
    sets = staged(toks.groupBy("tokens").agg(id_), "ask-sets")
    pairs = staged(similar_sets(sets.select("id", "tokens"), percent), "ask-pairs")
    state = sets.select("id", F.lit(None).cast("boolean").alias("founder"))
    while True:
        before = pairs.join(state.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.max(F.coalesce("founder", F.lit(False))).alias("joined"), F.max(F.col("founder").isNull()).alias("waits"))
        # an ask that no founder precedes waits while an earlier look-alike is open
        verdict = F.when(F.col("founder").isNotNull(), F.col("founder")).when(F.col("joined"), False).when(F.col("waits"), None).otherwise(True)
        state = staged(state.join(before, "id", "left").select("id", verdict.alias("founder")), "ask-state")
        if state.where(F.col("founder").isNull()).isEmpty():
            break
    founders = state.where("founder").select(F.col("id").alias("a"))
    home = pairs.join(founders, "a", "left_semi").groupBy("b").agg(F.min("a").alias("home"))
    fate = sets.join(home, sets["id"] == home["b"], "left").select("tokens", F.coalesce("home", "id")["rowid"].alias("founder"))
    return toks.join(fate, "tokens").select("rowid", "founder")


def recurring(asks: DataFrame, min_sessions: int = 2, percent: int = PERCENT) -> DataFrame:
    """``founder, sessions, first_ts, first_text, line`` of the groups seen in several sessions."""
    held = asks.join(group_asks(asks, percent), "rowid").select("founder", "session", text_of("ts").alias("ts"), "rowid", "text")
    groups = held.groupBy("founder").agg(F.count_distinct("session").alias("sessions"), F.min_by(F.struct("ts", "text"), F.struct("ts", "rowid")).alias("first")).where(F.col("sessions") >= min_sessions)
    line = F.format_string(LINE.replace("{}", "%s"), F.col("sessions").cast("string"), F.substring("first.ts", 1, 10), squeeze("first.text", 110))
    return groups.select("founder", "sessions", F.col("first.ts").alias("first_ts"), F.col("first.text").alias("first_text"), line.alias("line"))


def loops(rows: DataFrame, cutoff: str, project: str | None = None, limit: int = 10) -> DataFrame:
    """The ``limit`` asks that recur most among user rows from ``cutoff`` on; noise and headings aside."""
    asks = rows.where((F.col("role") == "user") & (text_of("ts") >= cutoff) & ~is_noise("text") & ~F.startswith(text_of("text"), F.lit("# ")))
    if project:
        asks = asks.where(F.col("project") == project)
    return recurring(asks.select("rowid", "text", "session", "ts")).orderBy(F.desc("sessions"), "first_ts", "founder").limit(limit)


def first_sightings(groups: DataFrame) -> DataFrame:
    """Groups numbered by when they were first seen, within a project."""
    return groups.withColumn("nth", F.row_number().over(Window.partitionBy("project").orderBy("first_ts", "founder")))
