"""Calibration reads lines once; ids of pieces are cut once for each piece between white space."""

import random

from lodestone.functions.wordpiece import WordPiece, normalize, words
from lodestone.operators import condense


def _survivors(body: str, needles: tuple[str, ...], x: str) -> tuple[int, int]:
    lines = body.split("\n")
    hit = [[n for n in needles if n in line] for line in lines]
    seed, run = [], False
    for line, h in zip(lines, hit, strict=True):
        run = any(n != x for n in h) or (run and line[:1] in (" ", "\t"))
        seed.append(run)
    keep = [i < 5 or i + 15 >= len(lines) or seed[i] or (i + 1 < len(lines) and seed[i + 1] and lines[i] != "") for i in range(len(lines))]
    sole = [h == [x] for h in hit]
    return sum(sole), sum(a and b for a, b in zip(sole, keep, strict=True))


def test_calibration_in_one_pass(spark):
    rng, needles = random.Random(3), ("aa", "bb", "cc")
    bodies = ["\n".join(rng.choice(("", " ", "\t")) + rng.choice(("aa", "bb", "cc", "aa cc", "x", "x", "x", "")) + "z" for _ in range(60)) for _ in range(40)]
    out = condense.calibrate(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string"), needles=needles)
    want = {n: tuple(map(sum, zip(*[_survivors(b, needles, n) for b in bodies], strict=True))) for n in needles}
    assert {r.needle: (r.lines, r.survived) for r in out.collect()} == want and all(0 < s < n for n, s in want.values())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # needles to counts; bodies are not joined with their needles


def test_ids_by_white_space():
    pieces = WordPiece({p: i for i, p in enumerate(["[UNK]", *"abcé.,", *("##" + c for c in "abc"), "東"])})
    calls = []
    plain, pieces._pieces = pieces._pieces, lambda w: calls.append(w) or plain(w)
    pieces._keep()
    for text in ("ab, ca.b Ab", "a\x1cb a\x85b", "a b c　a​b", "東ab東 É", "", " \x00a", "a" * 200, "İ \x1f"):
        slow = [i for w in words(normalize(text)) for i in plain(w)]
        assert list(memoryview(pieces.encode_bytes(text)).cast("i")) == slow == pieces.encode(text)
    calls.clear()
    pieces._keep()
    pieces.encode_bytes("ab " * 1000)
    assert calls == ["ab"] and pieces._chunk.cache_info().hits == 999
