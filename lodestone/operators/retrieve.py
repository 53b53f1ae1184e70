"""Gated retrieval for many prompts at once, and what a prompt is answered with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import content_terms, is_noise, term_overlap
from ..functions.text import ascii_lower, date_of, squeeze, stable_key, text_of
from ..plans.staging import staged
from .search import Index, document_frequency, score_batch, term_frequencies

MIN_TERMS, MIN_OVERLAP, CANDIDATES, ECHO_BYTES = 2, 2, 40, 25
MIN_CORPUS, DF_PERCENT, DF_FLOOR = 200, 6, 5


def prompt_terms(prompts: DataFrame) -> DataFrame:
    """``qid, terms`` of the prompts that ask something: not noise, two content terms or more."""
    return prompts.where(~is_noise("prompt")).select("qid", content_terms("prompt").alias("terms")).where(F.size("terms") >= MIN_TERMS)


def rare_terms(index: Index, asked: DataFrame, tf: DataFrame) -> DataFrame:
    """``qid, terms`` cut to the terms rare enough to mean something.

    ``tf``: frequencies of all terms asked for (``term, rowid, ...``), or their
    counts of rows (``term, df``).  Below
    ``MIN_CORPUS`` rows all pass; else a term has to occur in at least one row
    and in no more than ``DF_PERCENT`` of them (``DF_FLOOR`` rows at least).
    Prompts left with fewer than two terms ask nothing.
    """
    each = asked.select("qid", F.posexplode("terms").alias("at", "term"))
    df = tf if "df" in tf.columns else tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ceiling = F.greatest(F.lit(DF_FLOOR), F.floor(F.col("n") * DF_PERCENT / 100))
    kept = index.with_totals(each.join(df, "term", "left")).where((F.col("n") < MIN_CORPUS) | (F.col("df") <= ceiling))
    terms = F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"])
    return kept.groupBy("qid").agg(terms.alias("terms")).where(F.size("terms") >= MIN_TERMS)


def echoes(text: Column, prompt: Column) -> Column:
    """Whether a row is the prompt itself (or holds it, or is held by it)."""
    a, p = squeeze(ascii_lower(text), 400), squeeze(ascii_lower(prompt), 400)
    return (F.octet_length(p) >= ECHO_BYTES) & (F.contains(a, p) | F.contains(p, a))


def _with_vectors(ranked: DataFrame, vectors: DataFrame, ungated: bool) -> DataFrame:
    """Reciprocal-rank fusion per prompt with ``qid, rowid, rank`` of a vector leg."""
    one = ranked.select("qid", "rowid", (1.0 / (60 + F.col("rank"))).alias("s1"))
    two = vectors.select("qid", "rowid", (1.0 / (60 + F.col("rank"))).alias("s2"))
    both = one.join(two, ["qid", "rowid"], "full" if ungated else "left")
    both = both.select("qid", "rowid", (F.coalesce("s1", F.lit(0.0)) + F.coalesce("s2", F.lit(0.0))).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "rowid")
    return both.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < CANDIDATES)


def retrieve(
    index: Index,
    rows: DataFrame,
    prompts: DataFrame,
    limit: int = 3,
    gists: DataFrame | None = None,
    text_only: bool = False,
    vectors: DataFrame | None = None,
    ungated: bool = False,
) -> DataFrame:
    """``qid, rowid, rank, key, line`` for all ``prompts`` (``qid, prompt, exclude``) in one job.

    Gates in order: noise, two terms, rarity, then per prompt the best
    ``CANDIDATES`` rows by BM25 over any of the terms; of those, rows outside the
    excluded session whose first 400 characters hold two of the terms and that
    do not echo the prompt.  Ranks count what is left, from 1.
    """
    asked = staged(prompt_terms(prompts), "retrieve-asked")
    asked_for = lambda: asked.select(F.explode("terms").alias("term")).distinct()
    asked = staged(rare_terms(index, asked, document_frequency(index, asked_for())), "retrieve-rare")
    tf = staged(term_frequencies(index, asked_for(), "text" if text_only else None), "retrieve-tf")  # of rare terms only
    if text_only:  # the gate counts all columns, matching and scores one
        tf = tf.where(F.col("tf_in") > 0).select("term", "rowid", "dl", F.col("tf_in").alias("tf"))
    ranked = score_batch(index, asked.select("qid", F.explode("terms").alias("term")), tf, CANDIDATES)
    if vectors is not None:
        ranked = _with_vectors(ranked, vectors, ungated)
    head = F.substring(text_of("text"), 1, 400)
    found = (
        ranked.select("qid", "rowid", "rank")
        .join(rows.select("rowid", "ts", "role", "project", "session", head.alias("text"), stable_key("session", "ts", "role", "text").alias("key")), "rowid")
        .join(asked, "qid")
        .join(prompts.select("qid", "prompt", "exclude"), "qid")
        .where((text_of("exclude") == "") | (text_of("session") != F.col("exclude")))
        .where(term_overlap("text", "terms") >= MIN_OVERLAP)
        .where(~echoes(F.col("text"), F.col("prompt")))
    )
    order = Window.partitionBy("qid").orderBy("rank")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    body = F.col("text")
    if gists is not None:
        found = found.join(gists.where(F.col("gist") != "").select("key", "gist"), "key", "left")
        body = F.coalesce("gist", "text")
    line = F.concat(date_of("ts"), F.lit(" "), text_of("role"), F.when(text_of("project") == "", F.lit("")).otherwise(F.concat(F.lit("/"), F.col("project"))), F.lit(": "), squeeze(body, 160))
    return found.select("qid", "rowid", "rank", "key", line.alias("line"))


def scene_hits(scene_index: Index, row_index: Index, scenes: DataFrame, prompts: DataFrame) -> DataFrame:
    """``qid, rowid, key, line``: the best session summary of each prompt, if any passes.

    Rarity is judged by the conversation lane, ranking by the scenes' own.
    """
    asked = staged(prompt_terms(prompts), "scene-asked")
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    asked = staged(rare_terms(row_index, asked, term_frequencies(row_index, terms)), "scene-rare")
    ranked = score_batch(scene_index, asked.select("qid", F.explode("terms").alias("term")), staged(term_frequencies(scene_index, terms), "scene-tf"), CANDIDATES)
    found = (
        ranked.join(scenes.select("rowid", "title", "summary", "outcome", "session", "ts_end"), "rowid")
        .join(asked, "qid")
        .join(prompts.select("qid", "exclude"), "qid")
        .where((text_of("exclude") == "") | (text_of("session") != F.col("exclude")))
        .where(term_overlap(F.concat(text_of("title"), F.lit(" "), text_of("summary")), "terms") >= MIN_OVERLAP)
    )
    order = Window.partitionBy("qid").orderBy("rank")
    line = F.concat(text_of("title"), F.lit(" ("), text_of("outcome"), F.lit(", "), date_of("ts_end"), F.lit(")"))
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == 1).select("qid", "rowid", stable_key("session", "ts_end", F.lit("scene"), "title").alias("key"), line.alias("line"))


def recall_slots(scene: DataFrame, talk: DataFrame, work: DataFrame, prompts: DataFrame, seen: DataFrame | None = None, slots: int = 3) -> DataFrame:
    """``qid, slot, lane, key, line``: at most ``slots`` lines a prompt.

    A scene takes one slot; conversation comes up to all slots less the scene's
    and less one more while the work lane has something (the scene's line counts
    there again, so beside both a scene and work no talk is left); work fills
    what is left, marked as run.  Lines already given
    in the prompt's session (``seen``: ``session, key``) are passed over.  Prompts
    are taken to be of different sessions; repeats within a batch are the
    streaming form's business.
    """
    talk_of = lambda df, lane: df.select("qid", "rank", "key", "line", F.lit(lane).alias("lane"))
    lanes = talk_of(scene.withColumn("rank", F.lit(1)), 0).unionByName(talk_of(talk, 1)).unionByName(talk_of(work.where(F.col("rank") <= 2), 2))
    has_work = work.select("qid").distinct().withColumn("reserved", F.lit(1))
    lanes = lanes.join(has_work, "qid", "left").withColumn("reserved", F.coalesce("reserved", F.lit(0)))
    if seen is not None:
        lanes = lanes.join(prompts.select("qid", "session"), "qid").join(seen, ["session", "key"], "left_anti")
    first = Window.partitionBy("qid", "key").orderBy("lane", "rank")
    lanes = lanes.withColumn("again", F.row_number().over(first)).where(F.col("again") == 1)
    within = Window.partitionBy("qid", "lane").orderBy("rank")
    scenes_given = F.max(F.when(F.col("lane") == 0, F.lit(1)).otherwise(F.lit(0))).over(Window.partitionBy("qid"))
    lanes = lanes.withColumn("nth", F.row_number().over(within)).withColumn("scenes", scenes_given)
    lanes = lanes.where((F.col("lane") != 1) | (F.col("nth") <= F.lit(slots) - F.col("scenes") * 2 - F.col("reserved")))
    order = Window.partitionBy("qid").orderBy("lane", "nth")
    line = F.when(F.col("lane") == 2, F.concat(F.lit("(ran) "), F.col("line"))).otherwise(F.col("line"))
    return lanes.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= slots).select("qid", "slot", "lane", "key", line.alias("line"))


def recall_message(slots: DataFrame) -> DataFrame:
    """``qid, reply``: the hook reply as JSON; prompts without lines pass through unanswered."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("slot", "line"))), lambda x: F.concat(F.lit("\n· "), x["line"]))
    text = F.concat(F.lit("[recall] notes of earlier sessions that touch on this. Each is as old as its date; look again where it matters."), F.array_join(lines, ""))
    reply = F.to_json(F.struct(F.lit(True).alias("continue"), F.struct(F.lit("UserPromptSubmit").alias("hookEventName"), F.col("text").alias("additionalContext")).alias("hookSpecificOutput")))
    return slots.groupBy("qid").agg(text.alias("text")).select("qid", reply.alias("reply"))
