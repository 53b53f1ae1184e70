"""Cuts in a lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_own: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    A temporary folder stands in only where the session names none and all of
    Spark runs in this process; on a cluster that is an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
        base = _own[0]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    # once the table is there its shuffle files serve nothing
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)  # gone when the driver ends
    return spark.read.schema(df.schema).parquet(path)


def offsets(df: DataFrame, order: list[Column], size: Column, name: str = "offset", parts: int | None = None) -> DataFrame:
    """``df`` with the sum of ``size`` over all rows before each, in a total ``order``.

    Rows are dealt by ranges of the order; a range sums its own rows, and only
    one sum a range meets in one place.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = staged(df.withColumn("__size", size.cast("bigint")).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "offsets")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("__part").agg(F.sum("__size").alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0))).select("__part", "__base")
    inside = F.coalesce(F.sum("__size").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__inside", inside).join(F.broadcast(sums), "__part").withColumn(name, F.col("__base") + F.col("__inside")).drop("__part", "__size", "__inside", "__base")
