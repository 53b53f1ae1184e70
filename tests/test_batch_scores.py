"""Batches of prompts: every content term counts, and pairs of prompts and rows are not written."""

from pyspark.sql import functions as F

from lodestone.functions.predicates import content_terms
from lodestone.operators import search
from lodestone.plans import registry
from lodestone.plans.staging import staged


def test_all_terms_of_a_prompt(spark, tmp_path):
    words = [f"word{chr(97 + k)}" for k in range(15)]
    rows = [(0, 0, "user", " ".join(words)), (1, 1, "user", words[14]), (1, 2, "user", "nothing"), (2, 1, "user", "else")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert registry.batch_bm25(spark, str(tmp_path)).count() == 2  # the prompt itself, and the row with its fifteenth word


def test_pairs_are_not_written(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("rowid"), F.concat(F.lit("alpha beta gamma word"), (F.col("id") % 40).cast("string")).alias("text"))
    index = search.build_index(rows).stage()
    asked = rows.where("rowid % 4 = 0").select(F.col("rowid").alias("qid"), F.explode(content_terms("text", None)).alias("term"))
    most = []

    def count(df, name):
        out = staged(df, name)
        most.append((name, out.count()))
        return out

    monkeypatch.setattr(search, "staged", count)
    monkeypatch.setattr(search, "QUERY_BYTES", 4000)  # several blocks of prompts
    monkeypatch.setattr(search, "TASK_POSTINGS", 300)
    got = search.ranked_batch(index, asked, 3).collect()
    assert sum(n for name, n in most if name == "batch-best") == 300 and max(n for _, n in most) <= 1600
    for q in range(0, 400, 4):  # ten rows have all four words, ties go to the smallest
        mine = sorted((r.rank, r.rowid) for r in got if r.qid == q)
        assert mine == [(k, q % 40 + 40 * k) for k in range(3)]
