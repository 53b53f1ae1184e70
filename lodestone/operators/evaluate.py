"""Retrieval quality: does a question find the answer that followed it?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import is_noise
from ..functions.text import text_of
from ..plans.staging import offsets, staged
from .retrieve import retrieve
from .search import Index


def qa_pairs(rows: DataFrame) -> DataFrame:
    """``qid, question, session, ts, answer_rowid``: adjacent user and assistant rows of a session.

    The question has 20 bytes or more and is not noise, the answer 80 or more.
    ``qid`` is the answer's row.
    """
    w = Window.partitionBy("session").orderBy("ts", "rowid")
    talk = rows.where(F.col("role").isin("user", "assistant")).select("rowid", "role", "session", "ts", text_of("text").alias("text"))
    talk = talk.withColumn("before", F.lag("role").over(w)).withColumn("question", F.lag("text").over(w))
    return talk.where(
        (F.col("role") == "assistant") & (F.col("before") == "user") & (F.octet_length("text") >= 80) & (F.octet_length("question") >= 20) & ~is_noise("question")
    ).select(F.col("rowid").alias("qid"), "question", "session", "ts", F.col("rowid").alias("answer_rowid"))


def strided_sample(pairs: DataFrame, limit: int) -> DataFrame:
    """Evenly spaced rows in order of (session, ts, answer): every n-th of ceil(count / limit).

    Positions come from counts per session, so no single task orders all pairs.
    """
    total = pairs.agg(F.count(F.lit(1)).alias("total"))
    before = offsets(pairs.groupBy("session").agg(F.count(F.lit(1)).alias("size")), [F.col("session")], F.col("size")).select("session", "offset")
    at = F.row_number().over(Window.partitionBy("session").orderBy("ts", "answer_rowid")) - 1
    stride = F.greatest(F.ceil(F.col("total") / F.lit(limit)), F.lit(1))
    return pairs.withColumn("at", at).join(before, "session").crossJoin(F.broadcast(total)).where((F.col("at") + F.col("offset")) % stride == 0).drop("at", "offset", "total")


def recall_at_k(index: Index, rows: DataFrame, k: int = 3, limit: int = 400, cross_session: bool = False, **options) -> DataFrame:
    """One row: ``pairs, sampled, fired, hit_at_k, hit_at_1`` and their percentages.

    ``cross_session`` leaves out the question's own session, where its answer is,
    so it counts only answers repeated elsewhere.
    """
    pairs = staged(qa_pairs(rows), "recall-pairs")
    sample = staged(strided_sample(pairs, limit), "recall-sample")
    asked = sample.select("qid", F.col("question").alias("prompt"), (F.col("session") if cross_session else F.lit("")).alias("exclude"))
    hits = retrieve(index, rows, asked, k, **options)
    marked = hits.join(sample.select("qid", "answer_rowid"), "qid").groupBy("qid").agg(F.min(F.when(F.col("rowid") == F.col("answer_rowid"), F.col("rank"))).alias("at"))
    counts = marked.agg(F.count(F.lit(1)).alias("fired"), F.count("at").alias("hit_at_k"), F.count_if(F.col("at") == 1).alias("hit_at_1"))
    pct = lambda a, b: F.when(F.col(b) > 0, F.lit(100.0) * F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return (
        pairs.agg(F.count(F.lit(1)).alias("pairs"))
        .crossJoin(sample.agg(F.count(F.lit(1)).alias("sampled")))
        .crossJoin(counts)
        .select("*", pct("fired", "sampled").alias("fired_pct"), pct("hit_at_k", "sampled").alias("recall_k_pct"), pct("hit_at_1", "sampled").alias("recall_1_pct"))
    )
