"""Quality rules as a short-circuit cascade (operator 2).

Base statistics are computed for every text at once per Arrow chunk.  The rules
are then asked one after the other, each only about the rows that none before
it has rejected; those that read the text again (letters, repeated strings) cost
far more than those that compare statistics.  Their order comes from a bounded
sample: the rule that rejects most for its cost goes first, and the selectivity
of the next is that on the rows still left.  A verdict is the conjunction of all
rules, so the order changes the cost and never the result.
"""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, release, small_batches, text_buffers

#: Bytes of text whose statistics are found at once (a dozen 64-bit numbers for each byte).
CHUNK_BYTES = 1 << 20

#: Rows on which costs and selectivities are estimated (the bound of the sample).
SAMPLE_ROWS = 1000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123)]] = True


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of the flags inside each row."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


class Chunk:
    """The texts of a chunk and their base statistics."""

    def __init__(self, col: pa.Array):
        self.data, self.offs = text_buffers(col)
        data, offs, n = self.data, self.offs, len(self.offs) - 1
        word = ~_SPACE[data]
        start = word.copy()
        start[1:] &= ~word[:-1]
        inside = offs[:-1][offs[:-1] < len(data)]
        start[inside] = word[inside]
        self.n_words = _sums(start, offs)
        self.word_chars = _sums(word & ((data & 0xC0) != 0x80), offs)
        self.n_symbols = _sums(_SYMBOL[data], offs)
        self.n_dup_lines, self.n_lines = self._lines(start)
        self.n_repeat_words = self._repeats(word, start, n)

    def _lines(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, offs = self.data, self.offs
        n = len(offs) - 1
        if not len(data):
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        breaks = np.flatnonzero(data == 10)
        # lines are [begin, end): after each break or text start, up to the next break or text end
        begins = np.concatenate([offs[:-1], breaks + 1])
        row = np.concatenate([np.arange(n), np.searchsorted(offs, breaks, "right") - 1])
        order = np.lexsort((begins, row))
        begins, row = begins[order], row[order]
        ends = np.empty(len(begins), np.int64)
        ends[:-1] = np.where(row[1:] == row[:-1], begins[1:] - 1, offs[row[:-1] + 1])
        ends[-1] = offs[row[-1] + 1]
        c = np.concatenate([[0], np.cumsum(start)])
        worded = (c[ends] - c[begins]) > 0
        # a line may begin inside the run of a word only at a text's start, so starts count its words
        begins, ends, row = begins[worded], ends[worded], row[worded]
        n_lines = np.bincount(row, minlength=n)
        if not len(begins):
            return np.zeros(n, np.int64), n_lines
        raw = pa.py_buffer(np.ascontiguousarray(data))
        # the bytes between lines (a break or blank lines) go to lines of their own, left out afterwards
        edges = np.empty(2 * len(begins) + 1, np.int64)
        edges[0:-1:2], edges[1::2], edges[-1] = begins, ends, len(data)
        lines = pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), raw])
        ids = lines.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        key = row * (ids.max() + 1) + ids
        kinds = np.unique(key)
        per_row = np.bincount(kinds // (ids.max() + 1), minlength=n)
        return n_lines - per_row, n_lines

    def _repeats(self, word: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
        """Words inside 3-word windows that occur twice or more in their text."""
        data, offs = self.data, self.offs
        first = np.concatenate([[0], np.cumsum(self.n_words)])
        total = int(first[-1])
        if total < 3:
            return np.zeros(n, np.int64)
        dense = data[word]
        at = np.cumsum(word)[start] - 1
        words = pa.BinaryArray.from_buffers(pa.binary(), total, [None, pa.py_buffer(np.append(at, len(dense)).astype(np.int32)), pa.py_buffer(dense)])
        ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kinds = int(ids.max()) + 1
        row = np.repeat(np.arange(n), self.n_words)
        whole = row[2:] == row[:-2]
        pair = np.unique(ids[:-2] * kinds + ids[1:-1], return_inverse=True)[1]
        triple = np.unique(pair * kinds + ids[2:], return_inverse=True)[1]
        key = (row[2:] * (int(triple.max()) + 1) + triple)[whole]
        _, inv, counts = np.unique(key, return_inverse=True, return_counts=True)
        hit = np.zeros(total + 1, np.int64)
        at = np.flatnonzero(whole)[counts[inv] >= 2]
        np.add.at(hit, at, 1)
        edge = np.zeros(total + 1, np.int64)
        edge[: total] += hit[:total]
        edge[3:] -= hit[: total - 2]
        covered = np.cumsum(edge[:total]) > 0
        c = np.concatenate([[0], np.cumsum(covered)])
        return c[first[1:]] - c[first[:-1]]

    def flags(self, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Bytes of the chosen rows that the table marks."""
        return np.array([np.count_nonzero(table[self.data[self.offs[i] : self.offs[i + 1]]]) for i in rows], np.int64)

    def chars(self, row: int) -> np.ndarray:
        """Code points of a row."""
        return np.frombuffer(self.data[self.offs[row] : self.offs[row + 1]].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


@dataclass(frozen=True)
class Rule:
    """``rejects(chunk, rows)`` says which of the rows go."""

    name: str
    rejects: Callable[[Chunk, np.ndarray], np.ndarray]


def _shouting(c: Chunk, rows: np.ndarray) -> np.ndarray:
    return 10 * c.flags(_UPPER, rows) > 6 * np.maximum(c.flags(_ALPHA, rows), 1)


def _few_letters(c: Chunk, rows: np.ndarray) -> np.ndarray:
    letters = np.array([np.count_nonzero(_letters()[c.chars(i)]) for i in rows], np.int64)
    return 10 * letters < 7 * c.word_chars[rows]


#: Characters of a string that the rule on repetition counts.
GRAM = 12


def _gram_copies(c: Chunk, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), bool)
    for k, i in enumerate(rows):
        h = c.chars(i).astype(np.uint64) + np.uint64(1)
        for size in (1, 2):  # strings of 2 and 4 characters
            h = h[:-size] * np.uint64(pow(0x9E3779B97F4A7C15, size, 1 << 64)) + h[size:]
        eight = h[:-4] * np.uint64(pow(0x9E3779B97F4A7C15, 4, 1 << 64)) + h[4:]
        h = eight[:-4] * np.uint64(pow(0x9E3779B97F4A7C15, 4, 1 << 64)) + h[8:] if len(h) > 8 else h[:0]
        if len(h):
            h = np.sort(h ^ (h >> np.uint64(31)))
            out[k] = 10 * (1 + np.count_nonzero(h[1:] != h[:-1])) < 6 * len(h)
    return out


#: The production rules besides the base test.
RULES = (
    Rule("symbols", lambda c, r: 10 * c.n_symbols[r] > c.n_words[r]),
    Rule("word_length", lambda c, r: (c.word_chars[r] < 2 * c.n_words[r]) | (c.word_chars[r] > 12 * c.n_words[r])),
    Rule("line_copies", lambda c, r: 10 * c.n_dup_lines[r] > 6 * np.maximum(c.n_lines[r], 1)),
    Rule("shouting", _shouting),
    Rule("few_letters", _few_letters),
    Rule("gram_copies", _gram_copies),
)


def base_failed(c: Chunk) -> np.ndarray:
    return (c.n_words < 50) | (100 * c.n_repeat_words > 50 * c.n_words)


def cascade(chunk: Chunk, rules: tuple[Rule, ...], alive: np.ndarray) -> np.ndarray:
    """Which rows pass all rules; a rule sees the rows that are left."""
    for rule in rules:
        rows = np.flatnonzero(alive)
        if not len(rows):
            break
        alive = alive.copy()
        alive[rows[rule.rejects(chunk, rows)]] = False
    return alive


def best_order(rejected: np.ndarray, costs: np.ndarray) -> list[int]:
    """Rules by rejections per second, one after the other: ``rejected`` has a row per text and a column per rule, ``costs`` seconds a text."""
    left, order = np.ones(len(rejected), bool), []
    while len(order) < len(costs):
        rest = [k for k in range(len(costs)) if k not in order]
        order.append(max(rest, key=lambda k: (rejected[left, k].mean() / max(costs[k], 1e-12) if left.any() else 0.0, -costs[k])))
        left &= ~rejected[:, order[-1]]
    return order


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules in the order that :func:`best_order` gives for at most ``sample_rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", CHUNK_BYTES):
            chunk = Chunk(b.column(0))
            rows = np.flatnonzero(~base_failed(chunk))
            bits, costs = np.zeros(len(rows), np.int64), []
            for k, rule in enumerate(rules):
                rule.rejects(chunk, rows[:1])  # tables are built outside the measure
                t = time.perf_counter()
                bits |= rule.rejects(chunk, rows).astype(np.int64) << k
                costs.append(time.perf_counter() - t)
            yield pa.RecordBatch.from_arrays([pa.array([bits.tolist()], pa.list_(pa.int64())), pa.array([costs], pa.list_(pa.float64()))], ["bits", "costs"])

    found = docs.select("text").limit(sample_rows).mapInArrow(run, "bits array<bigint>, costs array<double>").collect()
    bits = np.array([x for r in found for x in r["bits"]], np.int64)
    if not len(bits):
        return tuple(rules)
    costs = np.sum([r["costs"] for r in found], 0) / len(bits)
    return tuple(rules[k] for k in best_order((bits[:, None] >> np.arange(len(rules)) & 1).astype(bool), costs))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (default ``doc_id``) with
    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    Null text has no words, so it fails the base test; repeated rows and null
    ids are judged each for itself; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    ordered = rule_order(docs, rules, sample_rows)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    stats = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "__text", CHUNK_BYTES):
            chunk = Chunk(b.column(len(keep)))
            bad = base_failed(chunk)
            cols = [b.column(k) for k in range(len(keep))]
            cols += [pa.array(getattr(chunk, s), pa.int64()) for s in stats]
            cols += [pa.array(bad), pa.array(cascade(chunk, ordered, ~bad))]
            yield pa.RecordBatch.from_arrays(cols, [*keep, *stats, "base_failed", "kept"])
        release()

    types = dict(src.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + "".join(f", {s} bigint" for s in stats) + ", base_failed boolean, kept boolean"
    return src.mapInArrow(run, schema)
