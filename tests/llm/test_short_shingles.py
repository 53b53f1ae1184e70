"""Variants of ordinary lines that shingles of 5 characters link and those of 10 do not."""

import random

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from lodestone.llm import lines, queries

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _variants():
    """Pairs of lines of 60 to 150 characters: one letter changed in mid-line, or one word."""
    r = random.Random(11)
    word = lambda n: "".join(r.choice(LETTERS) for _ in range(n))
    letter, other = [], []
    for size in range(60, 151, 3):
        for out in (letter, other):
            ws = []
            while sum(map(len, ws)) + len(ws) - 1 < size:
                ws.append(word(r.randint(3, 6)))
            line, k = " ".join(ws), len(ws) // 2
            if out is letter:
                at = len(line) // 2
                changed = line[:at] + ("#" if line[at] != "#" else "%") + line[at + 1 :]
            else:
                changed = " ".join([*ws[:k], word(len(ws[k])), *ws[k + 1 :]])
            out.append((line, changed))
    return letter, other


def _table(spark, tmp_path, pairs):
    docs = [(2 * i + k, text) for i, pair in enumerate(pairs) for k, text in enumerate(pair)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return docs


def test_op9_links_one_letter_and_one_word_variants(spark, tmp_path):
    letter, other = _variants()
    docs = _table(spark, tmp_path, letter + other)
    got = {x.doc_id: x.n_removed for x in queries.op9_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert got == {d: n for d, n, _ in brute.fewer_lines(docs, lines.SHORT_WIDTH)}
    assert [got[2 * i + 1] for i in range(len(letter))] == [1] * len(letter)
    at = len(letter)
    assert all(got[2 * (at + i) + 1] == 1 for i, (a, _) in enumerate(other) if len(a) >= 100)


def test_pipeline_stage_links_them_too(spark, tmp_path):
    letter, _ = _variants()
    _table(spark, tmp_path, letter)
    out = corpus_pipeline.line_dedup(spark, queries.table(spark, str(tmp_path), "documents"), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [2 * i for i in range(len(letter))]


@pytest.mark.parametrize("width", [3, 5, 10])
def test_any_width_against_plain_version(spark, width):
    df = queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    got = sorted(tuple(x) for x in lines.dedup_lines(df, width=width).select("doc_id", "n_removed", F.coalesce("text", F.lit("\0"))).collect())
    assert got == [(d, n, "\0" if t is None else t) for d, n, t in brute.fewer_lines([tuple(x) for x in df.collect()], width)]


def test_lines_of_one_character_are_alike_at_any_length(spark):
    docs = [(i, "-" * n) for i, n in enumerate((5, 30, 127, 128, 200, 161, 5000))] + [(50, "=" * 300), (51, "abcdef" * 4), (52, "abcdef" * 400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_removed) for r in lines.dedup_lines(df, width=5).collect())
    assert got == [(d, n) for d, n, _ in brute.fewer_lines(docs, 5)] and sum(n for _, n in got) == 7


def test_bands_catch_pairs_of_all_sizes():
    """Recall of the bands, no line being confirmed: sets at 0.85, on both sides of the bound between the two ways to sign."""
    import numpy as np

    r = np.random.default_rng(1)
    for n in (9, 60, 120, 130, 150, 170, 400):
        common, hs = int(np.ceil(2 * n * 0.85 / 1.85)), []
        for _ in range(300):
            u = r.integers(0, 1 << 32, 2 * n - common, dtype=np.uint64).astype(np.uint32)
            hs += [u[:n], u[n - common :]]
        h, lo = np.concatenate(hs), np.arange(600) * n
        for keys in (lines.band_keys(lines.minhash(h, lo, lo + n), 1), lines.band_keys(lines.binned(h, lo, lo + n)[0], 2)):
            assert (keys[::2] == keys[1::2]).any(1).mean() >= 0.99, n


def test_signing_works_in_blocks():
    """Hashes and bins are those of a plain version, and no temporary is as large as the signatures of all lines."""
    import tracemalloc

    import numpy as np

    r = random.Random(3)
    texts = ["".join(r.choice(LETTERS + "é日") for _ in range(r.randrange(90, 130))) for _ in range(3000)]
    raw = [x.encode() for x in texts]
    ends = np.cumsum([len(x) for x in raw])
    begins = ends - [len(x) for x in raw]
    h, lo, hi = lines.mixed_shingles(np.frombuffer(b"".join(raw), np.uint8), begins, ends, 5)
    tracemalloc.start()
    try:
        sig, filled = lines.binned(h, lo, hi)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak < 2 * sig.nbytes
    for i in (0, 255, 256, 257, 1111, 2999):
        mixed = []
        for at in range(len(texts[i]) - 4):
            x = pow(0x9E3779B1, -1, 1 << 32)  # the first character counts one more
            for c in texts[i][at : at + 5]:
                x = (x * 0x9E3779B1 + ord(c)) & 0xFFFFFFFF
            x = ((x ^ x >> 16) * 0x85EBCA6B) & 0xFFFFFFFF
            x = ((x ^ x >> 13) * 0xC2B2AE35) & 0xFFFFFFFF
            mixed.append(x ^ x >> 16)
        assert h[lo[i] : hi[i]].tolist() == mixed
        own = {}
        for x in mixed:
            own[x >> 24] = min(own.get(x >> 24, 1 << 24), x & 0xFFFFFF)
        assert filled[i] == len(own)
        assert sig[i].tolist() == [own[b] if b in own else next(own[o] for o in lines._LENDERS[:, b].tolist() if o in own) for b in range(256)]
