"""Like sets: no pair is lost by the signatures, and candidates are not written."""

import random

from lodestone.operators import recurrence
from lodestone.plans.staging import staged


def test_pairs_and_candidates(spark, monkeypatch):
    rng = random.Random(7)
    common = [f"c{k}" for k in range(300)]
    sets = [sorted(rng.sample(common, rng.randint(5, 150))) for _ in range(600)]
    for n in (5, 8, 20, 160, 1000):  # pairs at the threshold itself and one token short of it
        base = [f"x{n}_{k}" for k in range(n)]
        sets += [base, base[: -(-3 * n // 5)], base[: -(-3 * n // 5) - 1], [*base[: n - n // 4], *(f"y{n}_{k}" for k in range(n // 4))]]
    sets = [sorted(x) for x in {tuple(sorted(x)) for x in sets}]
    want = {(i, j) for i, a in enumerate(map(set, sets)) for j, b in enumerate(map(set, sets)) if i < j and 100 * len(a & b) >= 60 * len(a | b)}
    rows = {}

    def count(df, name):
        out = staged(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(recurrence, "staged", count)
    frame = spark.createDataFrame(list(enumerate(sets)), "id bigint, tokens array<string>")
    assert {tuple(r) for r in recurrence.similar_sets(frame).collect()} == want and len(want) > 10
    assert len(want) <= rows["like-pairs"] <= 20 * len(want)  # tens of thousands share a rare token


def test_no_sets(spark):
    assert recurrence.similar_sets(spark.createDataFrame([], "id bigint, tokens array<string>")).count() == 0
