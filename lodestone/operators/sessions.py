"""Per-session and per-project views: turns, rollups, digests, counts, briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import date_of, essence, squeeze, stable_key, text_of

TALK = ("user", "assistant", "system")
ROW_CHARS, DIGEST_BYTES, MIN_ROWS = 300, 6000, 5


def turn_final(entries: DataFrame) -> DataFrame:
    """``entries`` (``file, line_no, kind, ...``) with ``final``: whether an assistant text ends its turn.

    It does if what follows the run of assistant texts is a person, a summary or the end.
    """
    ahead = Window.partitionBy("file").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    following = F.first(F.when(F.col("kind") != "AssistantText", F.col("kind")), ignorenulls=True).over(ahead)
    return entries.withColumn("final", (F.col("kind") == "AssistantText") & F.coalesce(following.isin("UserHuman", "Summary"), F.lit(True)))


def rollup(rows: DataFrame, done: DataFrame | None = None, least: int = MIN_ROWS, roles: tuple[str, ...] = TALK) -> DataFrame:
    """``session, project, ts_start, ts_end, n_rows`` of sessions of ``least`` rows; those in ``done`` are left out."""
    talk = rows.where((text_of("session") != "") & F.col("role").isin(*roles))
    out = talk.groupBy("session").agg(F.min_by("project", F.struct("ts", "rowid")).alias("project"), F.min("ts").alias("ts_start"), F.max("ts").alias("ts_end"), F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)
    return out.join(done.select("session"), "session", "left_anti") if done is not None else out


def digests(rows: DataFrame, gists: DataFrame | None = None, cap: int = DIGEST_BYTES, roles: tuple[str, ...] = TALK) -> DataFrame:
    """``session, digest``: the first two rows and the longest ending within ``cap`` bytes, one line a row."""
    talk = rows.where((text_of("session") != "") & F.col("role").isin(*roles)).select("session", "ts", "rowid", "role", F.substring(text_of("text"), 1, ROW_CHARS).alias("text"))
    body = F.col("text")
    if gists is not None:
        talk = talk.withColumn("key", stable_key("session", "ts", "role", "text")).join(gists.where(F.col("gist") != "").select("key", "gist"), "key", "left")
        body = F.coalesce("gist", "text")
    talk = talk.withColumn("line", F.concat("role", F.lit(": "), squeeze(body, ROW_CHARS))).withColumn("bytes", F.octet_length("line") + 1)
    order = Window.partitionBy("session").orderBy("ts", "rowid")
    talk = talk.withColumn("i", F.row_number().over(order) - 1).withColumn("all", F.sum("bytes").over(Window.partitionBy("session")))
    talk = talk.withColumn("head", F.sum(F.when(F.col("i") < 2, F.col("bytes"))).over(Window.partitionBy("session")))
    talk = talk.withColumn("rest", F.sum("bytes").over(Window.partitionBy("session").orderBy(F.desc("ts"), F.desc("rowid"))))
    kept = talk.withColumn("keep", (F.col("all") <= cap) | (F.col("i") < 2) | (F.col("head") + F.col("rest") <= cap))
    gone = F.count_if(~F.col("keep"))
    parts = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which & F.col("keep"), F.struct("i", "line")))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    mark = F.when(gone > 0, F.concat(F.lit("[... "), gone.cast("string"), F.lit(" turns omitted ...]\n"))).otherwise(F.lit(""))
    return kept.groupBy("session").agg(F.concat(parts(F.col("i") < 2), mark, parts(F.col("i") >= 2)).alias("digest"))


def role_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n_rows"))


def project_rollup(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project").agg(F.count_distinct("session").alias("sessions"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_rows"))


def stats(rows: DataFrame, gists: DataFrame, roles: tuple[str, ...] = TALK) -> DataFrame:
    """One row: ``n_rows, sessions, files, notes, gists, knowledge`` (gists and notes together)."""
    r = rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(F.when(F.col("role").isin(*roles), F.col("session"))).alias("sessions"),
        F.count_distinct("file").alias("files"),
        F.count_if(F.col("role").isin("memory", "wiki")).alias("notes"),
    )
    g = gists.agg(F.count_if(text_of("gist") != "").alias("gists"))
    return r.crossJoin(g).withColumn("knowledge", F.col("notes") + F.col("gists"))  # one row each


def newest_gists(rows: DataFrame, gists: DataFrame, per_project: int = 3, window: int = 36) -> DataFrame:
    """``project, nth, line``: of each project's ``window`` newest rows the first few with a gist of 20 bytes."""
    talk = rows.where(F.col("role").isin("assistant", "user"))
    newest = Window.partitionBy("project").orderBy(F.desc("ts"), F.desc("rowid"))
    talk = talk.withColumn("at", F.row_number().over(newest)).where(F.col("at") <= window).withColumn("key", stable_key("session", "ts", "role", "text"))
    known = talk.join(gists.where(F.col("gist") != "").select("key", "gist"), "key").where((F.octet_length(essence("gist")) >= 20) & ~F.startswith(text_of("text"), F.lit("# Learning inbox")))
    line = F.concat(date_of("ts", "?"), F.lit(" "), squeeze("gist", 160))
    return known.withColumn("nth", F.row_number().over(Window.partitionBy("project").orderBy("at"))).where(F.col("nth") <= per_project).select("project", "nth", line.alias("line"))


def coverage(rows: DataFrame, vectors: DataFrame, distilled: DataFrame, forgotten: DataFrame, recalled: DataFrame) -> DataFrame:
    """One row: how far each lane reaches (rows, with vectors, with asks; judged, with gist; forgotten; sessions and lines recalled)."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(text_of("asks") != "").alias("with_asks"))
    kept = distilled.agg(F.count(F.lit(1)).alias("judged"), F.count_if(text_of("gist") != "").alias("with_gist"))
    given = recalled.agg(F.count_distinct("session").alias("recall_sessions"), F.count(F.lit(1)).alias("recalled"))
    return one.crossJoin(count(vectors, "embedded")).crossJoin(kept).crossJoin(count(forgotten, "forgotten")).crossJoin(given)  # one row each


def scene_worklist(rows: DataFrame, scenes: DataFrame, limit: int | None = None, roles: tuple[str, ...] = TALK) -> DataFrame:
    """Sessions without a scene, newest first."""
    todo = rollup(rows, scenes, roles=roles).orderBy(F.desc("ts_end"), "session")
    return todo.limit(limit) if limit else todo
