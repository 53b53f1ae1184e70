"""One incremental run of ingestion: changed files in, their old rows out, new rows gated and keyed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import project_label, text_of
from ..plans.staging import offsets, staged
from ..sources.transcripts import messages, parse_entries, read_notes, read_transcripts, replace_files, stale, talk_rows, work_rows
from .curate import new_rows

#: Files that one run takes up; the rest waits for the next.
PER_RUN = 5000
ROWS = "rowid bigint, text string, asks string, role string, project string, session string, ts string, file string"


@dataclass(frozen=True)
class Store:
    """The tables of a memory: conversation and notes, tool traffic, manifest, blocklist, vectors."""

    rows: DataFrame
    work: DataFrame
    files: DataFrame
    forgotten: DataFrame
    vectors: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Store:
        make = lambda schema: spark.createDataFrame([], schema)
        return cls(make(ROWS), make(ROWS), make("path string, size bigint, mtime bigint"), make("key string"), make("rowid bigint, embedding array<float>"))


def listing(spark: SparkSession, path: str, pattern: str, depth: str = "/*") -> DataFrame:
    """``path, size, mtime`` of files; their content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{path.rstrip('/')}{depth}")
    return files.select("path", F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))


def _project(file: Column | str, home: str) -> Column:
    return project_label(F.element_at(F.split(file, "/"), -2), home)


def _numbered(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Row ids after the largest known one, in order of file and line."""
    after = (known.agg(F.max("rowid")).head()[0] or 0) + 1
    return offsets(rows, [F.col("file"), F.col("line_no")], F.lit(1), "rowid").withColumn("rowid", F.col("rowid") + F.lit(after))


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("rowid").cast("bigint").alias("rowid"), "text", F.lit("").alias("asks"), "role", "project", "session", "ts", "file")


def ingest_transcripts(spark: SparkSession, path: str, store: Store, home: str = "/root", everything: bool = False, per_run: int = PER_RUN) -> tuple[Store, int]:
    """The store after taking up new and changed transcripts, and how many files those were.

    A changed file's rows, tool rows and vectors go first.  Of rows with equal
    keys the one already there stays, else the first by file and line; blocked
    keys never come back.  ``per_run`` bounds a run: files are taken in order of
    their path and the manifest says what is left.
    """
    found = listing(spark, path, "*.jsonl")
    todo = found if everything else stale(found, store.files)
    taken = staged(todo.orderBy("path").limit(per_run), "ingest-files")
    paths = [r["path"] for r in taken.select("path").collect()]  # bounded by per_run
    if not paths:
        return store, 0
    gone = taken.select(F.col("path").alias("file"))
    dropped = store.rows.join(gone, "file", "left_semi").select("rowid")
    kept = store.rows.join(gone, "file", "left_anti")
    lines = read_transcripts(spark, paths)
    entries = staged(parse_entries(lines), "ingest-entries")
    fresh = talk_rows(entries).withColumn("project", _project("file", home))
    fresh = fresh.withColumn("rowid", F.struct("file", "line_no"))  # the order in which equal keys are settled
    key = lambda df: df.select(F.concat_ws("|", text_of("session"), text_of("ts"), text_of("role"), F.substring(text_of("text"), 1, 64)).alias("key"))
    fresh = new_rows(fresh, key(kept), store.forgotten).drop("rowid", "key")
    rows = staged(kept.select(*[c.split()[0] for c in ROWS.split(", ")]).unionByName(_shaped(_numbered(fresh, store.rows))), "ingest-rows")
    traffic = work_rows(entries).withColumn("project", _project("file", home))
    work = staged(replace_files(store.work, _shaped(_numbered(traffic, store.work)), taken), "ingest-work")
    vectors = staged(store.vectors.join(dropped, "rowid", "left_anti"), "ingest-vectors")
    files = staged(store.files.join(taken.select("path"), "path", "left_anti").unionByName(taken), "ingest-manifest")
    return replace(store, rows=rows, work=work, vectors=vectors, files=files), len(paths)


def ingest_notes(spark: SparkSession, path: str, store: Store, role: str, project: str = "") -> Store:
    """The store with the notes below ``path``: one row each, changed ones anew; blocked notes stay out."""
    found = listing(spark, path, "*.md", "")
    taken = staged(stale(found, store.files), "ingest-notes")
    gone = taken.select(F.col("path").alias("file"))
    kept = store.rows.join(gone, "file", "left_anti")
    notes = read_notes(spark, path, role).join(gone, "file", "left_semi").withColumn("project", F.lit(project)).withColumn("line_no", F.lit(0))
    notes = new_rows(notes.withColumn("rowid", F.struct("file", "line_no")), spark.createDataFrame([], "key string"), store.forgotten).drop("rowid", "key")
    dropped = store.rows.join(gone, "file", "left_semi").select("rowid")
    rows = staged(kept.select(*[c.split()[0] for c in ROWS.split(", ")]).unionByName(_shaped(_numbered(notes, store.rows))), "ingest-rows")
    files = staged(store.files.join(taken.select("path"), "path", "left_anti").unionByName(taken), "ingest-manifest")
    return replace(store, rows=rows, vectors=staged(store.vectors.join(dropped, "rowid", "left_anti"), "ingest-vectors"), files=files)


def sweep(store: Store, found: DataFrame) -> Store:
    """The store without the rows of files (``path``) that are no longer there."""
    here = found.select(F.col("path").alias("file"))
    keep = lambda df: df.join(here, "file", "left_semi")
    rows = keep(store.rows)
    return replace(store, rows=rows, work=keep(store.work), vectors=store.vectors.join(rows.select("rowid"), "rowid", "left_semi"), files=store.files.join(found.select("path"), "path", "left_semi"))


def ingest(spark: SparkSession, transcripts: str, notes: dict[str, str], store: Store, model=None, home: str = "/root", everything: bool = False, per_run: int = PER_RUN) -> Store:
    """A whole run: transcripts, then notes (folder by role), then vectors of rows that have none.

    Vectors wait where a run was cut short or the store has none yet.
    """
    from .vectors import extend

    store, taken = ingest_transcripts(spark, transcripts, store, home, everything, per_run)
    for role, folder in notes.items():
        store = ingest_notes(spark, folder, store, role)
    if model is not None and taken < per_run and not store.vectors.isEmpty():
        store = replace(store, vectors=staged(extend(store.rows, store.vectors, model), "ingest-vectors"))
    return store


def session_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of one transcript, for the digest of its last turn."""
    return messages(read_transcripts(spark, [path]))
