"""Vector search, rank fusion and embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import text_of

RRF = 60
EMBED_CHARS, EMBED_BATCH = 2000, 256


#: Bytes of queries that are compared in one pass over the vectors.
QUERY_BYTES = 32 << 20


def _nearest(ids: np.ndarray, m: np.ndarray, qs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and exact distance of the best ``k`` rows of ``m`` for each query, ties by id."""
    rough = (m**2).sum(1)[None, :] - 2.0 * (qs @ m.T)
    keep = min(len(m), k + 8)  # some to spare for rounding; the rest is decided exactly
    at = np.argpartition(rough, keep - 1, 1)[:, :keep] if keep < len(m) else np.tile(np.arange(len(m)), (len(qs), 1))
    edge = np.take_along_axis(rough, at, 1).max(1)
    tied = np.flatnonzero((rough <= edge[:, None] + 1e-9).sum(1) > keep)
    rows = [np.flatnonzero(rough[q] <= edge[q] + 1e-9) if q in tied else at[q] for q in range(len(qs))] if len(tied) else list(at)
    out_q, out_id, out_d = [], [], []
    for q, r in enumerate(rows):
        d = np.sqrt(((m[r] - qs[q]) ** 2).sum(1))
        best = np.lexsort((ids[r], d))[:k]
        out_q.append(np.full(len(best), q))
        out_id.append(ids[r][best])
        out_d.append(d[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_d)


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact neighbours: ``qid, rowid, distance, rank`` (from 0) by L2 distance, ties by ``rowid``.

    ``queries`` (``qid, query``) is a stated set.  Blocks of it of at most
    ``QUERY_BYTES`` are compared, one pass over the vectors each, by matrix
    products; an Arrow batch hands on its own best ``k`` of a query.
    """
    width = width_of(vectors) or 1
    n = queries.count()
    blocks = max(1, -(-n * width * 8 // QUERY_BYTES))
    found = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        held = part.select(F.col("qid").cast("bigint").alias("qid"), "query").toArrow()  # bounded by QUERY_BYTES
        qids = held["qid"].to_numpy()
        if not len(qids):
            continue
        qs = np.array(held["query"].to_pylist(), np.float64).reshape(len(qids), -1)
        shared = vectors.sparkSession.sparkContext.broadcast((qids, qs))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            for batch in batches:
                if not batch.num_rows or not len(names):
                    continue
                ids = batch.column(0).to_numpy()
                m = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                for lo in range(0, len(names), 512):
                    q, i, d = _nearest(ids, m, matrix[lo : lo + 512], k)
                    yield pa.RecordBatch.from_arrays([pa.array(names[lo + q]), pa.array(i), pa.array(d)], ["qid", "rowid", "distance"])

        near = vectors.select(F.col("rowid").cast("bigint").alias("rowid"), "embedding").mapInArrow(run, "qid bigint, rowid bigint, distance double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "qid bigint, rowid bigint, distance double")
    order = Window.partitionBy("qid").orderBy("distance", "rowid")
    best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    return best.select("qid", "rowid", "distance", (F.col("nth") - 1).alias("rank"))


def fuse(keyword: DataFrame, vector: DataFrame, gated: bool = True) -> DataFrame:
    """Reciprocal-rank fusion of two ranked legs (``rowid, rank`` from 0): ``rowid, score``.

    Gated: vector hits re-rank keyword hits only; else either leg brings rows in.
    """
    one = keyword.select("rowid", (F.lit(1.0) / (RRF + F.col("rank"))).alias("s1"))
    two = vector.select("rowid", (F.lit(1.0) / (RRF + F.col("rank"))).alias("s2"))
    both = one.join(two, "rowid", "left" if gated else "full")
    return both.select("rowid", (F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0))).alias("score"))


def width_of(vectors: DataFrame) -> int | None:
    """Dimension of a vector table, null if it is empty."""
    row = vectors.select(F.size("embedding")).head()
    return row[0] if row else None


def pending(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """``rowid, text`` of rows without a vector, cut to the characters that are embedded."""
    return rows.join(vectors.select("rowid"), "rowid", "left_anti").select("rowid", F.substring(text_of("text"), 1, EMBED_CHARS).alias("text"))


def embed(rows: DataFrame, model) -> DataFrame:
    """``rowid, embedding`` by a model with ``encode(list of texts) -> matrix`` and ``dim``, broadcast once."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), EMBED_BATCH):
                part = f.iloc[lo : lo + EMBED_BATCH]
                yield pd.DataFrame({"rowid": part["rowid"].to_numpy(), "embedding": list(np.asarray(shared.value.encode(part["text"].tolist()), np.float32))})

    return rows.select("rowid", "text").mapInPandas(run, "rowid bigint, embedding array<float>")


def extend(rows: DataFrame, vectors: DataFrame, model) -> DataFrame:
    """The vector table with the missing rows embedded; refuses a table of another width."""
    width = width_of(vectors)
    if width is not None and width != model.dim:
        raise ValueError(f"the vectors have {width} dimensions, the model {model.dim}: embed all rows again")
    return vectors.select("rowid", "embedding").unionByName(embed(pending(rows, vectors), model))


def top_matches(vectors: DataFrame, model, text: str, k: int) -> DataFrame:
    """Ranked ``rowid``s nearest to a text."""
    spark = vectors.sparkSession
    query = spark.createDataFrame([(0, [float(x) for x in model.encode([text])[0]])], "qid int, query array<float>")
    return knn(vectors, query, k).select("rowid", "rank", "distance")
