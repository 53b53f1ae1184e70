"""Curation: judge requests and replies, verdicts, blocklist."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import stable_key, text_of
from ..plans.staging import staged

REPLY = "choices array<struct<message struct<content string>>>, error struct<message string>"
VERDICTS = "verdicts array<struct<id bigint, keep boolean, gist string, asks array<string>>>"
SCENES = "scenes array<struct<id bigint, title string, summary string, outcome string>>"


def worklist(rows: DataFrame, distilled: DataFrame, roles: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """``rowid, key, text`` (500 characters) of rows not judged yet."""
    return rows.where(F.col("role").isin(*roles)).select("rowid", stable_key("session", "ts", "role", "text").alias("key"), F.substring(text_of("text"), 1, 500).alias("text")).join(distilled.select("key"), "key", "left_anti")


def batches(work: DataFrame, size: int = 20, groups: int = 64) -> DataFrame:
    """``work`` with ``batch`` (a struct), at most ``size`` rows each, cut inside hash groups."""
    at = Window.partitionBy("part").orderBy("rowid")
    work = work.withColumn("part", F.pmod(F.xxhash64("rowid"), F.lit(groups)))
    return work.withColumn("batch", F.struct("part", F.floor((F.row_number().over(at) - 1) / size).alias("nth"))).drop("part")


def judge_request(work: DataFrame, rubric: str, model: str) -> DataFrame:
    """``batch, request``: one JSON request for each batch."""
    items = F.to_json(F.array_sort(F.collect_list(F.struct(F.col("rowid").alias("id"), "text"))))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return work.groupBy("batch").agg(items.alias("items")).select("batch", F.to_json(F.struct(F.array(message("system", F.lit(rubric)), message("user", F.concat(F.lit('{"rows":'), "items", F.lit("}")))).alias("messages"), F.lit(model).alias("model"), F.struct(F.lit("json_object").alias("type")).alias("response_format"), F.lit(0.0).alias("temperature"))).alias("request"))


def _inner(replies: DataFrame, schema: str) -> DataFrame:
    outer = replies.withColumn("r", F.from_json("reply", REPLY)).where(F.col("r.error.message").isNull())
    return outer.withColumn("inner", F.from_json(F.get(F.col("r.choices"), F.lit(0))["message"]["content"], schema))


def parse_verdicts(replies: DataFrame) -> DataFrame:
    """``id, keep, gist, asks`` out of replies (``reply``): errors, prose and verdicts without id or keep give nothing."""
    v = _inner(replies, VERDICTS).select(F.explode("inner.verdicts").alias("v")).select("v.*")
    return v.where(F.col("id").isNotNull() & F.col("keep").isNotNull()).select("id", "keep", text_of("gist").alias("gist"), F.coalesce("asks", F.array().cast("array<string>")).alias("asks"))


def parse_scenes(replies: DataFrame) -> DataFrame:
    """``id, title, summary, outcome``; scenes without id or summary are skipped."""
    s = _inner(replies, SCENES).select(F.explode("inner.scenes").alias("s")).select("s.*")
    return s.where(F.col("id").isNotNull() & (text_of("summary") != "")).select("id", text_of("title").alias("title"), "summary", F.lower(text_of("outcome")).alias("outcome"))


def upsert(table: DataFrame, news: DataFrame) -> DataFrame:
    """``key, gist`` where a key in ``news`` (``key, gist, arrived``) replaces the old entry; of several the latest."""
    fresh = news.groupBy("key").agg(F.max_by("gist", "arrived").alias("gist"))
    return table.select("key", "gist").join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


#: Asked of a model; ``provider(requests) -> replies`` stands between, so that any service or stub will do.
Provider = Callable[[list[str]], list[str]]
#: What each kind of request asks for: this library's own wording of the contract.
RUBRICS = {
    "user": "Each row is something a person said. Keep what shows a preference, a decision or a lasting fact. Answer as JSON: {\"verdicts\": [{\"id\": 0, \"keep\": true}]}.",
    "assistant": "Each row is how a turn ended. Keep results, causes and decisions; drop progress reports. Answer as JSON: {\"verdicts\": [{\"id\": 0, \"keep\": true}]}.",
    "durability": "Each row was kept. Where it will matter in months, give a gist of at most 120 characters and up to three questions that it answers. Answer as JSON: {\"verdicts\": [{\"id\": 0, \"keep\": true, \"gist\": \"\", \"asks\": []}]}.",
    "scene": "Each row is the digest of a session. Give a title, a summary and the outcome (done, partial, abandoned). Answer as JSON: {\"scenes\": [{\"id\": 0, \"title\": \"\", \"summary\": \"\", \"outcome\": \"\"}]}.",
}


def ask_provider(requests: DataFrame, provider: Provider) -> DataFrame:
    """``batch, reply`` of ``batch, request``; the provider sees the requests of an Arrow batch at once."""
    batch = requests.schema["batch"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(provider(b.column(1).to_pylist()), pa.string())], ["batch", "reply"])

    return requests.select("batch", "request").mapInArrow(run, f"batch {batch}, reply string")


def judged(work: DataFrame, rubric: str, provider: Provider, model: str = "judge", size: int = 20) -> DataFrame:
    """Verdicts (``id, keep, gist, asks``) on ``rowid, text`` whose id was asked in their batch; a failed batch gives none."""
    cut = staged(batches(work, size), "judge-batches")
    replies = ask_provider(judge_request(cut, RUBRICS[rubric], model), provider)
    said = _inner(replies, VERDICTS).select("batch", F.explode("inner.verdicts").alias("v")).select("batch", "v.*").where(F.col("id").isNotNull() & F.col("keep").isNotNull())
    asked = cut.select("batch", F.col("rowid").alias("id"))
    return said.join(asked, ["batch", "id"], "left_semi").select("id", "keep", text_of("gist").alias("gist"), F.coalesce("asks", F.array().cast("array<string>")).alias("asks"))


def distill(rows: DataFrame, distilled: DataFrame, provider: Provider, roles: tuple[str, ...] = ("assistant", "summary"), rubric: str = "assistant", model: str = "judge") -> tuple[DataFrame, DataFrame]:
    """Rows and verdict table after judging what has no verdict yet.

    What is kept is asked again, by itself, whether it deserves a gist and which
    questions it answers; a drop is recorded without gist and deletes nothing.
    Without reply to the second request a row is kept without gist.
    """
    todo = staged(worklist(rows, distilled, roles), "distill-work")
    first = staged(judged(todo.select("rowid", "text"), rubric, provider, model), "distill-verdicts")
    once = first.groupBy("id").agg(F.max("keep").alias("keep"))
    again = todo.join(once.where("keep").select(F.col("id").alias("rowid")), "rowid", "left_semi").select("rowid", "text")
    second = staged(judged(again, "durability", provider, model), "distill-gists")
    gist = second.where(F.col("gist") != "").groupBy("id").agg(F.max("gist").alias("gist"))
    found = once.join(gist, "id", "left").join(todo.select(F.col("rowid").alias("id"), "key"), "id")
    news = found.select("key", F.when(F.col("keep"), text_of("gist")).otherwise(F.lit("")).alias("gist"), F.col("id").alias("arrived"))
    asks = second.where(F.size("asks") > 0).groupBy("id").agg(F.array_join(F.max("asks"), " ").alias("asks")).select(F.col("id").alias("rowid"), "asks")
    return with_asks(rows, asks), upsert(distilled, news)


def build_scenes(sessions: DataFrame, digests: DataFrame, scenes: DataFrame, provider: Provider, model: str = "judge", size: int = 4) -> DataFrame:
    """New scenes (``title, summary, outcome, session, project, ts_start, ts_end, n_rows``) of sessions that have none.

    ``sessions``: a rollup; ``digests``: ``session, digest``.  An id that was not
    asked in its batch, or comes twice there, counts once or not at all.
    """
    todo = sessions.join(scenes.select("session"), "session", "left_anti").join(digests, "session")
    todo = staged(todo.withColumn("rowid", F.xxhash64("session").bitwiseAND(F.lit((1 << 53) - 1))), "scene-work")
    cut = staged(batches(todo.select("rowid", F.col("digest").alias("text")), size), "scene-batches")
    replies = ask_provider(judge_request(cut, RUBRICS["scene"], model), provider)
    said = _inner(replies, SCENES).select("batch", F.posexplode("inner.scenes").alias("at", "s")).select("batch", "at", "s.*").where(F.col("id").isNotNull() & (text_of("summary") != ""))
    said = said.join(cut.select("batch", F.col("rowid").alias("id")), ["batch", "id"], "left_semi")
    one = said.groupBy("id").agg(F.min_by(F.struct("title", "summary", "outcome"), F.struct("batch", "at")).alias("s"))
    return one.join(todo, one["id"] == todo["rowid"]).select(text_of("s.title").alias("title"), "s.summary", F.lower(text_of("s.outcome")).alias("outcome"), "session", "project", "ts_start", "ts_end", "n_rows")


def with_asks(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """Rows whose ``asks`` are replaced where a verdict (``rowid, asks``) brings some."""
    fresh = asks.select("rowid", F.col("asks").alias("fresh"))
    kept = [c for c in rows.columns if c != "asks"]
    return rows.join(fresh, "rowid", "left").select(*kept, F.coalesce("fresh", "asks").alias("asks"))


def new_rows(rows: DataFrame, known: DataFrame, forgotten: DataFrame) -> DataFrame:
    """Rows whose key is neither known nor blocked, the first of each key by ``rowid``."""
    keyed = rows.withColumn("key", stable_key("session", "ts", "role", "text"))
    fresh = keyed.join(known.select("key"), "key", "left_anti").join(forgotten.select("key"), "key", "left_anti")
    return fresh.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("rowid"))).where(F.col("nth") == 1).drop("nth")


def forget(rows: DataFrame, vectors: DataFrame, forgotten: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, vectors and blocklist after the rows ``ids`` (``rowid``) are forgotten."""
    keys = rows.join(ids.select("rowid"), "rowid", "left_semi").select(stable_key("session", "ts", "role", "text").alias("key"))
    gone = ids.select("rowid")
    return rows.join(gone, "rowid", "left_anti"), vectors.join(gone, "rowid", "left_anti"), forgotten.select("key").unionByName(keys).distinct()
