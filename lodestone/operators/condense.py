"""Condensing of long logs: edges, flagged lines and their context stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.predicates import any_of, condensable
from ..functions.text import ascii_lower, indented, plain_name, plural, split_lines, text_of

# Lines kept at both ends, and what flags a line.
HEAD, TAIL = 5, 15
NEEDLES = (
    "error", "fail", "panic", "traceback", "undefined reference", "fatal",
    "segmentation fault", "assertion", "exception", "warning", "deprecated",
    "command not found", "no such file", "permission denied", "cannot access",
    "cannot stat", "cannot find", "cannot open", "unable to", "not found",
    "couldn't", "could not", "refused", "timed out", "killed", "aborted",
    "denied", "invalid", "unexpected", "missing", "expected",
)


def flagged_lines(bodies: DataFrame, needles: tuple[str, ...] = NEEDLES) -> DataFrame:
    """``doc_id, i, n, line, needle``: the lines of each body and whether they hold a needle."""
    parts = bodies.select("doc_id", split_lines("body").alias("lines"))
    return parts.select("doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line")).withColumn("needle", any_of(ascii_lower("line"), needles))


def kept_lines(lines: DataFrame, drags: bool = True) -> DataFrame:
    """``lines`` with ``keep``: both ends, flagged lines, the indented run below
    a flagged line and the line above it unless that is empty."""
    order = Window.partitionBy("doc_id").orderBy("i")
    seed: Column = F.col("needle")
    lines = lines.withColumn("island", F.sum(F.when(indented("line"), 0).otherwise(1)).over(order))
    if drags:
        within = Window.partitionBy("doc_id", "island").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seed = F.max("needle").over(within)
    lines = lines.withColumn("seed", seed)
    above = F.coalesce(F.lead("seed").over(order), F.lit(False)) & (F.col("line") != "") if drags else F.lit(False)
    edge = (F.col("i") < HEAD) | (F.col("i") + TAIL >= F.col("n"))
    return lines.withColumn("keep", edge | F.col("seed") | above)


def condense(bodies: DataFrame, spill: Column | None = None, drags: bool = True, needles: tuple[str, ...] = NEEDLES, tag: str = "lodestone") -> DataFrame:
    """``doc_id, text, elided, flagged, grew`` of ``doc_id, body``; ``spill`` names where the whole body is.

    Gaps are marked in place.  A result that is not shorter than the body gives
    way to the body, with zero counts.  Null and empty bodies stay as they are.
    """
    lines = kept_lines(flagged_lines(bodies, needles), drags)
    order = Window.partitionBy("doc_id").orderBy("i")
    lines = lines.withColumn("run", F.sum(F.col("keep").cast("int")).over(order))
    in_run = Window.partitionBy("doc_id", "run")
    gap = F.sum((~F.col("keep")).cast("int")).over(in_run)
    opens = ~F.col("keep") & F.coalesce(F.lag("keep").over(order), F.lit(True))
    piece = F.when(F.col("keep"), F.concat("line", F.lit("\n"))).when(F.col("opens"), F.concat(F.lit("⟨… "), plural(F.col("gap"), "line"), F.lit(" …⟩\n")))
    made = (
        lines.withColumn("gap", gap).withColumn("opens", opens).withColumn("piece", piece)
        .groupBy("doc_id")
        .agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("i", "piece")))), lambda x: x["piece"]), "").alias("kept"),
            F.count_if(~F.col("keep")).alias("elided"),
            F.count_if("needle").alias("flagged"),
        )
    )
    where = F.when(F.coalesce(spill, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(" · full: "), spill)) if spill is not None else F.lit("")
    out = bodies.select("doc_id", "body", where.alias("at")).join(made, "doc_id", "left")
    head = F.concat(F.lit(f"⟨{tag}: "), plural(F.col("elided"), "line"), F.lit(" elided · "), F.col("flagged").cast("string"), F.lit(" flagged"), F.col("at"), F.lit("⟩\n"))
    out = out.withColumn("made", F.concat(head, F.col("kept")))
    grew = F.col("made").isNull() | (F.octet_length("made") >= F.octet_length(text_of("body")))
    zero = F.lit(0).cast("bigint")
    return out.select(
        "doc_id",
        F.when(grew, F.col("body")).otherwise(F.col("made")).alias("text"),
        F.when(grew, zero).otherwise(F.col("elided")).alias("elided"),
        F.when(grew, zero).otherwise(F.col("flagged")).alias("flagged"),
        grew.alias("grew"),
    )


def condense_tools(events: DataFrame) -> DataFrame:
    """Condensed output of the tool events (``doc_id, tool, body``) that are worth it."""
    return condense(events.where(condensable("tool", "body")).select("doc_id", "body"))


def spill(events: DataFrame, path: str) -> DataFrame:
    """``events`` (``session, tool_use_id, tool, body``) that could be kept whole below ``path``, with ``spill``, where.

    Both names have to be plain path components.  What was written is read back
    and compared, so nothing is condensed whose original is not there.
    """
    named = events.where(plain_name("session") & plain_name("tool_use_id"))
    named.select("session", "tool_use_id", text_of("body").alias("body")).write.mode("append").partitionBy("session").parquet(path)
    kept = events.sparkSession.read.schema("session string, tool_use_id string, body string").parquet(path).select("session", "tool_use_id", F.md5("body").alias("sum")).distinct()
    held = named.withColumn("sum", F.md5(text_of("body"))).join(kept, ["session", "tool_use_id", "sum"], "left_semi")
    return held.drop("sum").withColumn("spill", F.concat(F.lit(path.rstrip("/") + "/session="), "session", F.lit("#"), "tool_use_id"))


def condense_events(events: DataFrame, path: str) -> DataFrame:
    """``session, tool_use_id, reply``: replies to tool events worth condensing; all others pass through unanswered."""
    held = spill(events.where(condensable("tool", "body")), path).withColumn("doc_id", F.struct("session", "tool_use_id"))
    made = condense(held.select("doc_id", "body", "spill"), F.col("spill")).where(~F.col("grew"))
    out = F.struct(F.lit("PostToolUse").alias("hookEventName"), F.col("text").alias("updatedToolOutput"))
    return made.select("doc_id.session", "doc_id.tool_use_id", F.to_json(F.struct(F.lit(True).alias("continue"), out.alias("hookSpecificOutput"))).alias("reply"))


def calibrate(bodies: DataFrame, drags: bool = True, needles: tuple[str, ...] = NEEDLES) -> DataFrame:
    """``needle, lines, survived``: of the lines that only this needle flags, how many stay without it.

    A line is flagged without needle ``x`` if it has another one, so the least and
    the last of the needles so far in its indented run tell it for every ``x``:
    bodies are read once, and the lines themselves are not shuffled.
    """
    def nearest(numbers: range) -> Column:
        return F.coalesce(*[F.when(F.contains("line", F.lit(needles[k])), F.lit(k)) for k in numbers])

    parts = bodies.select("doc_id", split_lines(ascii_lower("body")).alias("lines"))
    lines = parts.select("doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    lines = lines.select("doc_id", "i", "n", indented("line").alias("below"), (F.col("line") == "").alias("empty"), nearest(range(len(needles))).alias("least"), nearest(range(len(needles) - 1, -1, -1)).alias("last"))
    lines = lines.withColumn("sole", F.col("least") == F.col("last"))
    order = Window.partitionBy("doc_id").orderBy("i")
    lines = lines.withColumn("island", F.sum(F.when(F.col("below"), 0).otherwise(1)).over(order))
    one = F.col("least")
    if drags:
        within = Window.partitionBy("doc_id", "island").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        lines = lines.withColumn("first_in", F.min("least").over(within)).withColumn("last_in", F.max("last").over(within))
        lines = lines.withColumn("first_next", F.lead("first_in").over(order)).withColumn("last_next", F.lead("last_in").over(order))
        seed = (F.col("first_in") != one) | (F.col("last_in") != one)
        above = ~F.col("empty") & F.coalesce((F.col("first_next") != one) | (F.col("last_next") != one), F.lit(False))
    else:
        seed = above = F.lit(False)
    edge = (F.col("i") < HEAD) | (F.col("i") + TAIL >= F.col("n"))
    name = F.element_at(F.array(*[F.lit(n) for n in needles]), one + 1)
    kept = lines.where("sole").select(name.alias("without"), (edge | seed | above).alias("keep")).groupBy("without").agg(F.count(F.lit(1)).alias("lines"), F.count_if("keep").alias("survived"))
    listed = F.explode(F.array(*[F.lit(n) for n in needles])).alias("needle")
    zero = F.lit(0).cast("bigint")
    return bodies.sparkSession.range(1).select(listed).join(kept.withColumnRenamed("without", "needle"), "needle", "left").select("needle", F.coalesce("lines", zero).alias("lines"), F.coalesce("survived", zero).alias("survived"))


def savings(bodies: DataFrame, needles: tuple[str, ...] = NEEDLES) -> DataFrame:
    """One row ``bodies, before, after``: bytes of the bodies large enough, whole and condensed."""
    large = bodies.where(F.octet_length(text_of("body")) >= 2048)
    made = condense(large, needles=needles).select("doc_id", F.octet_length("text").alias("after"))
    both = large.select("doc_id", F.octet_length("body").alias("before")).join(made, "doc_id")
    return both.agg(F.count(F.lit(1)).alias("bodies"), F.coalesce(F.sum("before"), F.lit(0)).alias("before"), F.coalesce(F.sum("after"), F.lit(0)).alias("after"))
