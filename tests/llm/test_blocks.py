"""Blocks of large buckets against all pairs, compared one by one."""

import random

import numpy as np
import pyarrow as pa

import brute
from lodestone.llm.cluster import common_counts, pair_counts, spanning_links
from lodestone.llm.lines import line_sets, similar_pairs


def load(col):
    return line_sets(col, 10)


def _roots(n, edges):
    root = list(range(n))
    for a, b in edges:
        old, new = root[b], root[a]
        root = [new if r == old else r for r in root]
    return {frozenset(i for i in range(n) if root[i] == r) for r in root}


def test_spanning_links_join_what_all_similar_pairs_join():
    rng = random.Random(3)
    words = ["alpha", "béta", "gamma", "delta", "epsilon", "zeta", "日本", "theta"]
    base = [" ".join(rng.choices(words, k=40)) for _ in range(3)]
    texts = ["short", "", "0123456789"]
    for _ in range(45):
        parts = rng.choice(base).split()
        for k in rng.sample(range(40), rng.randint(0, 4)):
            parts[k] = rng.choice(words)
        texts.append(" ".join(parts))
    n = len(texts)
    own = [i % 2 for i in range(n)]

    def table(i, j):
        rows = [k for k in range(n) if own[k] in (i, j)]
        return pa.table({"i": pa.array([i] * len(rows), pa.int32()), "j": pa.array([j] * len(rows), pa.int32()), "own": pa.array([own[k] for k in rows], pa.int32()), "bucket": [7] * len(rows), "v": rows, "hub": [-1] * len(rows), "label": rows, "items": [texts[k] for k in rows]})

    got = [(r["a"], r["b"]) for i, j in ((0, 0), (0, 1), (1, 1)) for r in spanning_links(table(i, j), load, 80).to_pylist()]
    want = [(a, b) for a in range(n) for b in range(a + 1, n) if brute.alike_lines(texts[a], texts[b], 80)]
    assert want and set(got) <= set(want)
    assert _roots(n, got) == _roots(n, want)
    assert len(spanning_links(table(0, 1), load, 80)) < n


def test_spanning_links_leave_out_what_is_joined_already():
    line = "one line of text that is said twice"
    t = pa.table({"i": pa.array([0, 0], pa.int32()), "j": pa.array([0, 0], pa.int32()), "own": pa.array([0, 0], pa.int32()), "bucket": [7, 7], "v": [1, 2], "hub": [0, 0], "label": [1, 1], "items": [line, line + "."]})
    assert spanning_links(t, load, 80).num_rows == 0


def test_many_buckets_in_one_task():
    lines = ["one line of text that is said twice", "one line of text that is said twice.", "nothing like any of the others here"]
    rows = [(b, 10 * b + k, x) for b in (1, 2, 3) for k, x in enumerate(lines)]
    z = pa.array([0] * 9, pa.int32())
    t = pa.table({"i": z, "j": z, "own": z, "bucket": [r[0] for r in rows], "v": [r[1] for r in rows], "hub": [0] * 9, "label": [r[1] for r in rows], "items": [r[2] for r in rows]})
    assert [(r["a"], r["b"]) for r in spanning_links(t, load, 80).to_pylist()] == [(10, 11), (20, 21), (30, 31)]


def test_a_member_of_many_buckets_comes_with_its_set_once():
    lines = {1: "one line of text that is said twice", 2: "one line of text that is said twice.", 3: "nothing like any of the others here"}
    rows = [(5, 1, None), (5, 3, None), (6, 1, lines[1]), (6, 2, lines[2]), (7, 2, None), (7, 3, lines[3])]
    z = pa.array([0] * 6, pa.int32())
    t = pa.table({"i": z, "j": z, "own": z, "bucket": [r[0] for r in rows], "v": [r[1] for r in rows], "hub": [0] * 6, "label": [r[1] for r in rows], "items": pa.array([r[2] for r in rows], pa.string())})
    assert [(r["a"], r["b"]) for r in spanning_links(t, load, 80).to_pylist()] == [(1, 2)]


def test_counts_of_shared_hashes():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 30))).astype(np.uint64) for _ in range(40)]
    flat, offs = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    left, right = np.arange(0, 25), np.arange(15, 40)
    want = np.array([[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left])
    assert ((common_counts(flat, offs, left, right) == want) | (left[:, None] == right[None, :])).all()
    wide, x, y = flat * np.uint64(0x9E3779B97F4A7C15), np.repeat(left, 25), np.tile(right, 25)
    assert ((pair_counts(wide, offs, x, y) == want.ravel()) | (x == y)).all()


def test_pairs_of_lines():
    rng = random.Random(8)
    base = "".join(rng.choice("abcde ") for _ in range(90))
    a, b = [], []
    for n in range(60):
        one = list(base)
        for _ in range(n % 9):
            one[rng.randrange(len(one))] = rng.choice("abcde é")
        a.append("".join(one))
        b.append(base[n % 4 :] if n % 11 else "")
    assert similar_pairs(pa.array(a), pa.array(b), 80, 5).tolist() == [brute.alike_lines(x, y, 80, 5) for x, y in zip(a, b, strict=True)]


def test_components_of_chains_and_stars(spark):
    from lodestone.llm.components import components

    r = random.Random(12)
    n = 400
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(a, b) for a, b in ((r.randrange(200, n), r.randrange(200, n)) for _ in range(130))] + [(5, 5), (None, 3), (7, 6)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    parts = [x for x in _roots(n, [(a, b) for a, b in edges if a is not None]) if len(x) > 1]
    got = {}
    for row in components(df).collect():
        got.setdefault(row.label, set()).add(row.v)
    assert {frozenset(x) for x in got.values()} == set(parts) and all(k == min(v) for k, v in got.items())
    assert components(df.limit(0)).count() == 0
