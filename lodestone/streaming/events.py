"""Event rules as streams: each reply is given once a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import ADVICE, classify_prompt

PROMPT = "prompt string, session_id string"


def read_events(spark: SparkSession, path: str, schema: str = PROMPT, per_trigger: int = 1000) -> DataFrame:
    """A stream over a folder of JSON events; ``per_trigger`` bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def hints(events: DataFrame) -> DataFrame:
    """``session_id, category, reply``: advice for a prompt's category, once per session and category.

    Works on a batch or a stream; a stream keeps the pairs it has answered.
    """
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    found = events.withColumn("category", classify_prompt("prompt")).where(F.col("category").isNotNull())
    return found.dropDuplicates(["session_id", "category"]).select("session_id", "category", F.concat(F.lit("[hint] this "), advice[F.col("category")]).alias("reply"))


def once(lines: DataFrame, ttl: str | None = None, at: str = "ts") -> DataFrame:
    """Recalled lines (``session, key, ...``) not given in their session before; without a session all are given.

    A stream keeps what it has given; with ``ttl`` (say ``"7 days"``) it forgets
    it that long after its time ``at``, so its state is bounded.
    """
    named = F.coalesce(F.col("session"), F.lit("")) != ""
    keyed = lines.withColumn("__once", F.when(named, F.struct(F.col("session"), F.col("key"), F.lit("").alias("n"))).otherwise(F.struct(F.lit("").alias("session"), F.col("key"), F.uuid().alias("n"))))
    first = keyed.withWatermark(at, ttl).dropDuplicatesWithinWatermark(["__once"]) if ttl else keyed.dropDuplicates(["__once"])
    return first.drop("__once")
