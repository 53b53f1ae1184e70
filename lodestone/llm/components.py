"""Connected components over an edge table: distributed union-find by contraction.

Each task first joins the edges that it holds by union-find and hands on one
star for each of its components, so chains get short.  Then, every round, each vertex takes the least id among itself and its neighbours,
follows two such pointers, and the edges are rewritten to the ids taken; edges
inside one id vanish.  Maps of all rounds are then chained.  Neighbour lists
are never gathered: a round is one aggregation with partial minima and joins
on unique keys, and its tables are written to the shared folder, so no round
depends on an executor that is gone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (smallest vertex, other vertex) of the components of all the edges of a task."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = root[up]
            k = up
        return k

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    found = [(find(k), k) for k in root]
    found = [(a, b) for a, b in found if a != b]
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _jump(m: DataFrame) -> DataFrame:
    to = m.select(F.col("v").alias("label"), F.col("label").alias("next"))
    return m.join(to, "label").select("v", F.col("next").alias("label"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v, label`` for every vertex with an edge; ``label`` is the least id of its component.

    Null ends and loops are ignored; repeated edges count once; without edges
    the result is empty.
    """
    pair = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b")))
    left = staged(pair.mapInArrow(stars, "a bigint, b bigint"), "components-edges")
    maps: list[DataFrame] = []
    old = [left]
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ends.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("label")).select("v", F.least("v", "label").alias("label"))
        m = staged(_jump(_jump(least)), "components-map")
        maps.append(m)
        left = staged(
            left.join(m.select(F.col("v").alias("a"), F.col("label").alias("x")), "a")
            .join(m.select(F.col("v").alias("b"), F.col("label").alias("y")), "b")
            .where(F.col("x") != F.col("y"))
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .mapInArrow(stars, "a bigint, b bigint"),
            "components-edges",
        )
        old.append(left)
    if not maps:
        return left.select(F.col("a").alias("v"), F.col("b").alias("label"))
    out = maps[0]
    for m in maps[1:]:
        out = out.join(m.select(F.col("v").alias("label"), F.col("label").alias("next")), "label", "left").select("v", F.coalesce("next", "label").alias("label"))
    out = staged(out, "components-label")
    unstage(*old, *maps)
    return out
