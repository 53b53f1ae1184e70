"""BPE encoding and decoding by a tokenization automaton (operator 8).

*Compilation.*  The automaton starts as one state with a loop for every byte.
Each merge ``(u, v) -> w``, in order, installs one gadget: the state reached by
``u`` is copied without its ``v`` arc, the ``u`` arcs are redirected to the
copy, and every state with a ``u`` arc gets a ``w`` arc to where ``v`` led.
All arcs with one label reach the same state, so a state is named by its last
label and stored as what the gadgets took away from it: ``cuts[(u, v)]`` is the
gadget's rank, and a label made by a merge inherits, up to that merge's rank,
the cuts of its right part.  A path of the finished automaton is exactly a
correct tokenization (Berglund, Martens and van der Merwe, "Constructing a BPE
tokenization DFA").

*Encoding.*  Reading a pre-split word byte by byte, the automaton's arcs are
followed through a trie of their labels.  The sets of possible positions are
determinised on demand and kept in a transition table, so a known stretch costs
one table step per byte.  Every prefix has one correct tokenization, so each
state knows its last label and the word's ids are read off backwards.

*Decoding* emits the bytes of the arc labels one after the other.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, release, small_batches, text_buffers
from .pieces import PieceCache

#: The pre-tokenizer's pattern (fixed value; the vocabulary file names it by kind only).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: States kept before the table of transitions is begun anew.
MAX_STATES = 300_000
#: States with which a worker may stay idle; with more, all it compiled goes (compiling again takes a second).
KEPT_STATES = 50_000


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """A byte-level BPE vocabulary file compiled to an automaton."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model, symbols = spec["model"], byte_symbols()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.labels: list[bytes] = [b""] * self.size
        for token, k in vocab.items():
            if token not in self.special:
                self.labels[k] = bytes(symbols[c] for c in token)
        for token, k in self.special.items():
            self.labels[k] = token.encode()
        self.left = [-1] * self.size
        self.right = [-1] * self.size
        self.rank = [-1] * self.size
        #: (u, v) -> rank of the gadget that cut v after u
        self.cuts: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            u, v = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            w = vocab["".join(merge.split(" ") if isinstance(merge, str) else merge)]
            self._gadget(rank, u, v, w)
        self._trie(t for k, t in enumerate(self.labels) if t and k not in set(self.special.values()))
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.split = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")") if self.special else None
        self.label_column = pa.array(self.labels, pa.large_binary())
        self._fresh()

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.cuts.setdefault((u, v), rank)
        if self.rank[w] < 0:
            self.left[w], self.right[w], self.rank[w] = u, v, rank

    def _trie(self, labels) -> None:
        ids = {t: k for k, t in enumerate(self.labels)}
        self.child: dict[int, int] = {}
        self.token = [-1]
        for label in labels:
            node = 0
            for b in label:
                key = node << 8 | b
                if (to := self.child.get(key)) is None:
                    to = self.child[key] = len(self.token)
                    self.token.append(-1)
                node = to
            self.token[node] = ids[label]

    def _fresh(self) -> None:
        #: a state: its last label, then a trie node and the label before it for each label that is being read, in one flat tuple
        self.keys: dict[tuple[int, ...], int] = {(-1,): 0}
        self.states: list[tuple[int, ...]] = [(-1,)]
        self.table: dict[int, int] = {}
        self.known: dict[int, bool] = {}

    def follows(self, t: int, x: int) -> bool:
        """Whether the state after label ``t`` has an arc ``x``."""
        if t < 0:
            return True
        if (known := self.known.get(t * self.size + x)) is not None:
            return known
        held, z, until = True, x, 1 << 60
        while held and z >= 0:
            y, limit = t, 1 << 60
            while y >= 0:
                c = self.cuts.get((y, z))
                if c is not None and c < limit and c <= until:
                    held = False
                    break
                limit, y = self.rank[y], self.right[y]
            until, z = self.rank[z], self.left[z]
        self.known[t * self.size + x] = held
        return held

    def _step(self, at: int, byte: int) -> int:
        """Compute and keep one transition of the table."""
        state = self.states[at]
        moved, done = [-1], -1
        for node, before in (*zip(state[1::2], state[2::2], strict=True), (0, state[0])):
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            moved += to, before
            x = self.token[to]
            if done < 0 and x >= 0 and self.follows(before, x):
                done = x
        moved[0] = done
        key = tuple(moved)
        if (k := self.keys.get(key)) is None:
            k = self.keys[key] = len(self.states)
            self.states.append(key)
        self.table[at << 8 | byte] = k
        return k

    def word(self, data: bytes) -> list[int]:
        """The ids of one pre-split word."""
        if len(self.states) > MAX_STATES:
            self._fresh()
        table, at, path = self.table, 0, [0]
        for b in data:
            to = table.get(at << 8 | b)
            at = self._step(at, b) if to is None else to
            path.append(at)
        out, i = [], len(data)
        while i:
            t = self.states[path[i]][0]
            out.append(t)
            i -= len(self.labels[t])
        out.reverse()
        return out

    def words(self, text: str) -> list[str]:
        """The pre-tokenizer's words of a text without special strings."""
        if max(text, default="") >= "\U00010000":  # newer Unicode versions differ there
            at, out = 0, []
            for _, (a, b) in self.pre.pre_tokenize_str(text):
                out.append(text[a:b])
                at = b
            return out if at == len(text) and "".join(out) == text else self.split.findall(text)
        return self.split.findall(text)

    def encode(self, text: str) -> list[int]:
        parts = self.specials.split(text) if self.specials and "<" in text else [text]
        out: list[int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for w in self.words(part):
                    out += self.word(w.encode())
        return out

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.encode(t) for t in texts]
        lens = np.array([len(x) for x in ids], np.int64)
        return np.array([k for x in ids for k in x], np.uint32), lens

    def emit(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the labels, and the offset of each id's first byte."""
        return text_buffers(self.label_column.take(pa.array(ids.astype(np.uint32, copy=False))))

    def decode(self, ids: np.ndarray) -> str:
        return self.emit(np.asarray(ids))[0].tobytes().decode("utf-8", "replace")


_compiled: dict[str, tuple[Automaton, PieceCache]] = {}


def compiled(path: str) -> tuple[Automaton, PieceCache]:
    """The automaton of a vocabulary, compiled once in each worker process as long as it is small."""
    if path not in _compiled:
        a = Automaton(path)
        _compiled[path] = (a, PieceCache(a.encode_many, np.uint32))
        release()  # what compiling took
    return _compiled[path]


def settle() -> None:
    """What a task leaves behind: idle workers stay small beside the next stage's."""
    for path in [p for p, (a, _) in _compiled.items() if len(a.states) > KEPT_STATES]:
        del _compiled[path]
    release()


def encode_decode(docs: DataFrame, vocab_path: str, keep: list[str] | None = None, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (default ``doc_id``),
    ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; on request the ``ids`` and
    the ``decoded`` text.  No shuffle.

    Null text counts as empty (no ids; the digests of nothing); rows with null
    or repeated ``doc_id`` are kept as they are; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, cache = compiled(vocab_path)
        for b in by_bytes(batches, "__text", 2 << 20):
            ids, offs = cache.texts(b.column(len(keep)))
            raw, at = automaton.emit(ids)
            n = b.num_rows
            wide = ids.astype("<u4")
            view, text = memoryview(wide).cast("B"), memoryview(np.ascontiguousarray(raw))
            id_sha, de_sha, decoded = [], [], []
            for i in range(n):
                lo, hi = int(offs[i]), int(offs[i + 1])
                id_sha.append(hashlib.sha256(view[4 * lo : 4 * hi]).hexdigest())
                part = bytes(text[int(at[lo]) : int(at[hi])])
                try:
                    part.decode("utf-8")
                except UnicodeDecodeError:
                    part = part.decode("utf-8", "replace").encode()
                de_sha.append(hashlib.sha256(part).hexdigest())
                if with_text:
                    decoded.append(part.decode())
            cols = [b.column(k) for k in range(len(keep))]
            cols += [pa.array(np.diff(offs), pa.int64()), pa.array(id_sha, pa.string()), pa.array(de_sha, pa.string())]
            names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            if with_text:
                cols.append(pa.array(decoded, pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names)
            ids = offs = raw = at = wide = view = text = cols = None
            release()  # else what a chunk took adds up between the states that stay
        automaton = cache = None
        settle()

    types = dict(src.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * with_ids + ", decoded string" * with_text
    return src.mapInArrow(run, schema)
