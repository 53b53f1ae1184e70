"""What a session starts with: signals waiting, a project's state, open loops, topics on file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import date_of, squeeze, text_of

TOPICS, TOPIC_BYTES, THRESHOLD = 8, 60, 5
#: What a brief says: wording of this library.
STATE = "[state] "
SIGNALS = " notes wait in this project's inbox. Read them early, keep what should last (corrections, preferences, ways of working), and clear the rest."
LOOPS = "[loops] asked again and again, not settled yet:"
ON_FILE = "[topics] pages on file: "


def state(project: Column | str, sessions: Column, last: Column, lines: Column, budget: int = 1400) -> Column:
    """A project's brief within ``budget`` bytes, empty if no line fits.

    ``lines``: array of ``part, nth, label, line`` in order; a section ends at its
    first line that does not fit, the next one is tried all the same.
    """
    seen = F.when(F.octet_length(text_of(last)) >= 10, F.concat(F.lit(", last "), F.substring(last, 1, 10))).otherwise(F.lit(""))
    head = F.concat(F.lit(STATE), project, F.lit(" — "), sessions.cast("string"), F.lit(" session(s) on file"), seen, F.lit(":"))
    start = F.struct(head.alias("out"), F.lit(-1).alias("closed"))

    def add(acc: Column, x: Column) -> Column:
        longer = F.concat(acc["out"], F.lit("\n"), x["label"], F.lit(" · "), x["line"])
        full = F.octet_length(acc["out"]) + F.octet_length(x["line"]) + 16 > budget
        return F.when(acc["closed"] == x["part"], acc).when(full, F.struct(acc["out"].alias("out"), x["part"].alias("closed"))).otherwise(F.struct(longer.alias("out"), acc["closed"].alias("closed")))

    made = F.aggregate(lines, start, add, lambda acc: acc["out"])
    return F.when(made == head, F.lit("")).otherwise(made)


def project_states(rows: DataFrame, open_lines: DataFrame, done_lines: DataFrame, budget: int = 1400) -> DataFrame:
    """``project, state`` from lines ``project, nth, line`` of what is open and what was done (three of each)."""
    label = lambda df, part, name: df.where(F.col("nth") <= 3).select("project", F.struct(F.lit(part).alias("part"), F.col("nth").cast("int").alias("nth"), F.lit(name).alias("label"), squeeze("line", 140).alias("line")).alias("x"))
    lines = label(open_lines, 0, "open").unionByName(label(done_lines, 1, "done")).groupBy("project").agg(F.array_sort(F.collect_list("x")).alias("lines"))
    head = rows.where(text_of("project") != "").groupBy("project").agg(F.count_distinct("session").alias("sessions"), F.max("ts").alias("last"))
    out = head.join(lines, "project").select("project", state(F.col("project"), F.col("sessions"), F.col("last"), F.col("lines"), budget).alias("state"))
    return out.where(F.col("state") != "")


def topics(pages: DataFrame, most: int = TOPICS) -> DataFrame:
    """One row ``topics``: ``name — first line`` of the first pages (``file, session, text``) by path, and how many more there are."""
    lines = F.filter(F.split(text_of("text"), "\n"), lambda x: x.rlike(r"^[ \t]*[^ \t#]"))
    first = squeeze(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), TOPIC_BYTES)
    named = pages.select("file", F.concat("session", F.lit(" — "), F.when(first == "", F.lit("(empty)")).otherwise(first)).alias("topic"))
    shown = named.orderBy("file").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "topic"))), lambda x: x["topic"]), " | ").alias("menu"))
    total = pages.agg(F.count(F.lit(1)).alias("n"))
    more = F.when(F.col("n") > most, F.concat(F.lit(" | +"), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return shown.crossJoin(total).select(F.concat("menu", more).alias("topics"))  # one row each


def nudges(events: DataFrame, signals: DataFrame, states: DataFrame, loops: DataFrame, topics: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``eid, reply`` for session starts (``eid, project, source``); what has nothing to say passes through.

    Signals from ``threshold`` on, and the project's state, are always given;
    loops (``nth, line``, three) and topics not where a session resumes or was
    compacted.
    """
    three = loops.where(F.col("nth") <= 3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), " // ").alias("open"))
    e = events.join(signals, "project", "left").join(states, "project", "left").crossJoin(F.broadcast(three)).crossJoin(F.broadcast(topics))  # one row each
    fresh = ~F.coalesce(F.col("source"), F.lit("")).isin("resume", "compact")
    sections = F.array_compact(
        F.array(
            F.when(F.coalesce("signals", F.lit(0)) >= threshold, F.concat(F.col("signals").cast("string"), F.lit(SIGNALS))),
            F.when(text_of("state") != "", F.col("state")),
            F.when(fresh & (text_of("open") != ""), F.concat(F.lit(LOOPS + " // "), "open")),
            F.when(fresh & (text_of("topics") != ""), F.concat(F.lit(ON_FILE), "topics")),
        )
    )
    text = F.array_join(sections, "\n\n")
    meter = F.concat(F.lit(" [context injected: "), F.format_number(F.octet_length(text) / 1000.0, 1), F.lit("kB]"))
    spoken = F.struct(F.lit(True).alias("continue"), F.struct(F.lit("SessionStart").alias("hookEventName"), F.concat(text, meter).alias("additionalContext")).alias("hookSpecificOutput"))
    return e.select("eid", F.when(F.size(sections) > 0, F.to_json(spoken)).otherwise(F.lit('{"continue": true}')).alias("reply"))


def numbered(lines: DataFrame, *order: Column) -> DataFrame:
    """Lines (``project, line``) with their place ``nth`` in the project."""
    return lines.withColumn("nth", F.row_number().over(Window.partitionBy("project").orderBy(*order)))


def dated(line: Column, ts: Column) -> Column:
    return F.concat(date_of(ts, "?"), F.lit(" "), line)
