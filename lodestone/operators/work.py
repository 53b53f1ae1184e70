"""What a turn did: files, commands and skills, failures and outcome, and the notes made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import is_noise, looks_like_correction
from ..functions.text import basename, blank, flatten_path, head_of_command, iso_minute, project_label, squeeze, text_of

# What a digest keeps, and the tools it reads.
FILES, COMMANDS, OUTCOME_BYTES, ASK_BYTES = 6, 4, 220, 300
EDITORS = ("Edit", "Write", "NotebookEdit", "MultiEdit")
AGENTS = ("Task", "Agent")


def _argument(block: Column, name: str) -> Column:
    """A tool's argument where it is a text, else empty."""
    v = F.try_element_at(block["input"], F.lit(name))
    return text_of(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def tool_uses(blocks: Column | str) -> tuple[Column, Column, Column]:
    """Files edited, commands run (their first piece) and skills or agents called, in order."""
    used = F.filter(blocks, lambda b: b["type"] == "tool_use")
    said = lambda xs: F.filter(xs, lambda x: x != "")
    pick = lambda test, make: said(F.transform(F.filter(used, test), make))
    files = pick(lambda b: b["name"].isin(*EDITORS), lambda b: basename(_argument(b, "file_path")))
    commands = pick(lambda b: b["name"] == "Bash", lambda b: head_of_command(_argument(b, "command")))
    agent = lambda b: F.when(_argument(b, "subagent_type") == "", F.lit("")).otherwise(F.concat(F.lit("agent:"), _argument(b, "subagent_type")))
    skills = pick(lambda b: (b["name"] == "Skill") | b["name"].isin(*AGENTS), lambda b: F.when(b["name"] == "Skill", _argument(b, "skill")).otherwise(agent(b)))
    return files, commands, skills


def failures(blocks: Column | str) -> Column:
    return F.size(F.filter(blocks, lambda b: (b["type"] == "tool_result") & F.coalesce(b["is_error"], F.lit(False))))


def turn_steps(messages: DataFrame) -> DataFrame:
    """``file, line_no, real, ask, files, commands, skills, failures, said`` of user and assistant messages.

    A real user message has text that is not noise; it opens a turn.  What tools
    returned counts as failed where it says so, on other user messages only.
    """
    user = F.coalesce(F.col("type") == "user", F.lit(False)) | F.coalesce(F.col("role") == "user", F.lit(False))
    assistant = ~user & (F.coalesce(F.col("type") == "assistant", F.lit(False)) | F.coalesce(F.col("role") == "assistant", F.lit(False)))
    m = messages.where(user | assistant)
    real = user & ~blank("text") & ~is_noise("text")
    none = F.array().cast("array<string>")
    lists = [F.when(assistant, c).otherwise(none).alias(name) for c, name in zip(tool_uses("blocks"), ("files", "commands", "skills"), strict=True)]
    return m.select("file", "line_no", real.alias("real"), F.when(real, F.col("text")).alias("ask"), *lists, F.when(user & ~real, failures("blocks")).otherwise(F.lit(0)).alias("failures"), F.when(assistant & ~blank("text"), F.col("text")).alias("said"))


def _first_seen(name: str, most: int) -> Column:
    """Distinct items in order of first appearance, at most so many."""
    steps = F.array_sort(F.collect_list(F.struct("line_no", name)))
    return F.slice(F.array_distinct(F.flatten(F.transform(steps, lambda x: x[name]))), 1, most)


def digest(steps: DataFrame) -> DataFrame:
    """``file, ask, files, commands, skills, failures, outcome`` of each file's last turn."""
    turn = F.sum(F.col("real").cast("int")).over(Window.partitionBy("file").orderBy("line_no"))
    rows = steps.withColumn("turn", turn).withColumn("last", F.max("turn").over(Window.partitionBy("file"))).where(F.col("turn") == F.col("last"))
    return rows.groupBy("file").agg(
        F.coalesce(F.max("ask"), F.lit("")).alias("ask"),
        _first_seen("files", FILES).alias("files"),
        _first_seen("commands", COMMANDS).alias("commands"),
        _first_seen("skills", COMMANDS).alias("skills"),
        F.sum("failures").cast("int").alias("failures"),
        F.coalesce(squeeze(F.max_by("said", F.when(F.col("said").isNotNull(), F.col("line_no"))), OUTCOME_BYTES), F.lit("")).alias("outcome"),
    )


def detail_lines() -> Column:
    """A digest's indented lines: what was done, and how it ended; none for mere talk."""
    part = lambda name, label, sep: F.when(F.size(name) > 0, F.concat(F.lit(f"{label}: "), F.array_join(name, sep)))
    failed = F.when(F.col("failures") > 0, F.concat(F.col("failures").cast("string"), F.lit(" failed")))
    parts = F.array_compact(F.array(part("files", "files", ", "), part("commands", "ran", " | "), part("skills", "skills", ", "), failed))
    did = F.when(F.size(parts) > 0, F.concat(F.lit("    "), F.array_join(parts, "  ·  ")))
    return F.array_compact(F.array(did, F.when(F.col("outcome") != "", F.concat(F.lit("    did: "), F.col("outcome")))))


def capture(digests: DataFrame, now: Column) -> DataFrame:
    """``file, entry``: the inbox entry of each digest whose ask is not noise; ``now`` in seconds."""
    flag = F.when(looks_like_correction("ask"), F.lit("correction?")).otherwise(F.lit("note"))
    head = F.concat(F.lit("- ["), iso_minute(now), F.lit("] ("), flag, F.lit(") "), squeeze("ask", ASK_BYTES), F.lit("\n"))
    worked = (F.size("files") > 0) | (F.size("commands") > 0) | (F.size("skills") > 0)
    details = F.when(worked, F.array_join(F.transform(detail_lines(), lambda x: F.concat(x, F.lit("\n"))), "")).otherwise(F.lit(""))
    return digests.where((F.col("ask") != "") & ~is_noise("ask")).select("file", F.concat(head, details).alias("entry"))


def inbox_name(cwd: Column | str, home: str) -> Column:
    """The inbox of a working directory: its project's label."""
    return project_label(flatten_path(cwd), home)


def append_inbox(entries: DataFrame, path: str) -> None:
    """Append entries (``project, entry``) to the inboxes below ``path``, one folder a project."""
    entries.select("project", F.rtrim(F.col("entry"), F.lit("\n")).alias("value")).write.mode("append").partitionBy("project").text(path)


def inbox_counts(lines: DataFrame) -> DataFrame:
    """``project, signals``: entries waiting in each inbox (``project, value``)."""
    return lines.groupBy("project").agg(F.count_if(F.col("value").rlike(r"^[ \t]*- \[")).alias("signals"))
