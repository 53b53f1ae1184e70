"""Transcript files (one JSON object a line) and notes as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import above_floor, is_noise
from ..functions.text import blank, clip_bytes, iso_date, text_of
from ..operators.sessions import turn_final

TOOL_BYTES = 1200
#: A line's fields; ``input`` keeps the order in which a tool's arguments stand.
HEAD = "type string, summary string, timestamp string, sessionId string, isSidechain boolean, message struct<role string, content variant>"
BLOCKS = "message struct<content array<struct<type string, text string, name string, input map<string, variant>, is_error boolean, content variant>>>"


def read_transcripts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line_no, value`` of every ``*.jsonl`` right below the project folders of ``path``, or of a list of files."""
    reader = spark.read.format("binaryFile")
    files = reader.load(path) if isinstance(path, list) else reader.option("pathGlobFilter", "*.jsonl").load(f"{path.rstrip('/')}/*")
    return files.select(F.col("path").alias("file"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line_no", "value"))


def _text(v: Column) -> Column:
    """A variant's text where it is one, else null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _texts_in(v: Column) -> Column:
    """Texts of a tool result: itself, or those of its blocks."""
    inner = F.transform(F.coalesce(F.try_variant_get(v, "$", "array<struct<text string>>"), F.array().cast("array<struct<text string>>")), lambda b: b["text"])
    return F.when(F.schema_of_variant(v) == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(inner)


def messages(lines: DataFrame) -> DataFrame:
    """``file, line_no, type, role, summary, ts, session, text, blocks`` of the lines that are messages or summaries.

    Broken JSON and sidechains give nothing.  ``text`` joins a message's text
    blocks; ``blocks`` is empty for plain texts.
    """
    e = lines.withColumn("e", F.from_json("value", HEAD)).withColumn("b", F.from_json("value", BLOCKS)["message"]["content"]).where(F.try_parse_json("value").isNotNull())
    e = e.where(~F.coalesce(F.col("e.isSidechain"), F.lit(False)))
    blocks = F.coalesce("b", F.from_json(F.lit("[]"), BLOCKS[len("message struct<content ") : -1]))
    said = F.coalesce(_text(F.col("e.message.content")), F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), " "))
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"\.jsonl$", "")
    session = F.when(text_of(F.col("e.sessionId")) == "", stem).otherwise(F.col("e.sessionId"))
    return e.select("file", "line_no", F.col("e.type").alias("type"), F.col("e.message.role").alias("role"), F.col("e.summary").alias("summary"), text_of(F.col("e.timestamp")).alias("ts"), session.alias("session"), stem.alias("stem"), (F.col("e.message.content").isNotNull()).alias("has_content"), said.alias("text"), blocks.alias("blocks"))


def parse_entries(lines: DataFrame) -> DataFrame:
    """``file, line_no, kind, text, ts, session`` of the lines that are entries; all others are skipped.

    An assistant message with a tool call is AssistantTool, a user message with
    a result UserTool; sidechains, blank texts and broken JSON give nothing.
    Tool text is the tool's name and its arguments that are texts, in their
    order, or what came back, cut to ``TOOL_BYTES`` bytes.
    """
    e = messages(lines).where((F.col("type") == "summary") | (F.col("type").isin("user", "assistant") & F.col("has_content")))
    has = lambda kind: F.exists("blocks", lambda b: F.coalesce(b["type"] == kind, F.lit(False)))
    kind = (
        F.when(F.col("type") == "summary", "Summary")
        .when((F.col("type") == "assistant") & has("tool_use"), "AssistantTool")
        .when(F.col("type") == "assistant", "AssistantText")
        .when(has("tool_result"), "UserTool")
        .otherwise("UserHuman")
    )
    args = lambda b: F.filter(F.transform(F.map_values(b["input"]), _text), lambda x: x.isNotNull())
    of = lambda name, parts: F.flatten(F.transform(F.filter("blocks", lambda b: b["type"] == name), parts))
    none = F.array().cast("array<string>")
    used = of("tool_use", lambda b: F.concat(F.array_compact(F.array(b["name"])), F.coalesce(args(b), none)))
    result = F.filter(of("tool_result", lambda b: F.coalesce(_texts_in(b["content"]), none)), lambda x: x.isNotNull())
    capped = lambda parts: clip_bytes(F.array_join(parts, " "), TOOL_BYTES)
    text = F.when(kind == "Summary", F.col("summary")).when(kind == "AssistantTool", capped(used)).when(kind == "UserTool", capped(result)).otherwise(F.col("text"))
    summary = F.col("type") == "summary"
    out = e.select("file", "line_no", kind.alias("kind"), text_of(text).alias("text"), F.when(summary, F.lit("")).otherwise(F.col("ts")).alias("ts"), F.when(summary, F.col("stem")).otherwise(F.col("session")).alias("session"))
    return out.where(F.col("kind").isin("AssistantTool", "UserTool") | ~blank("text"))


def talk_rows(entries: DataFrame) -> DataFrame:
    """``file, line_no, role, text, ts, session`` of the entries worth indexing as conversation."""
    role = F.when(F.col("kind") == "UserHuman", "user").when(F.col("kind") == "Summary", "summary").when(F.col("kind") == "AssistantText", "assistant")
    e = turn_final(entries).withColumn("role", role)
    keep = F.col("role").isNotNull() & ((F.col("kind") != "AssistantText") | F.col("final"))
    return e.where(keep).where(above_floor("role", "text") & ~is_noise("text")).select("file", "line_no", "role", "text", "ts", "session")


def work_rows(entries: DataFrame, least: int = 40) -> DataFrame:
    """Tool calls and their output of ``least`` bytes or more."""
    return entries.where(F.col("kind").isin("AssistantTool", "UserTool") & (F.octet_length("text") >= least)).select("file", "line_no", F.lit("tool").alias("role"), "text", "ts", "session")


def read_notes(spark: SparkSession, path: str, role: str) -> DataFrame:
    """``file, role, text, ts, session`` of Markdown notes, one row each; blank notes give none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    text = F.col("content").cast("string")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    return files.where(~blank(text)).select(F.col("path").alias("file"), F.lit(role).alias("role"), text.alias("text"), iso_date(F.unix_timestamp("modificationTime")).alias("ts"), stem.alias("session"))


def stale(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (``path, size, mtime``) that are new or changed against the manifest."""
    old = manifest.select("path", F.col("size").alias("s"), F.col("mtime").alias("m"))
    return found.join(old, "path", "left").where(F.col("s").isNull() | (F.col("s") != F.col("size")) | (F.col("m") != F.col("mtime"))).select(found.columns)


def replace_files(table: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """``table`` without the rows of changed files (``path``), and the fresh rows."""
    return table.join(changed.select(F.col("path").alias("file")), "file", "left_anti").unionByName(fresh, allowMissingColumns=True)
