"""Steps of a plan that are computed once and kept in the shared folder, and joins whose broadcast side is checked."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
FEW = 100_000
#: Bytes of a table's files that a task gets at most when the table is dealt out anew.
SHARE = 4 << 20


def step(df: DataFrame) -> DataFrame:
    """`df`, computed and written to the session's spark.checkpoint.dir; a temporary folder only where a local session names
    none."""
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='steps-')}")
    return df.checkpoint()


def small(df: DataFrame, most: int = FEW) -> DataFrame:
    """A broadcast of a side with `most` rows at most; Spark deals a larger one out in blocks."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(rows: DataFrame) -> DataFrame:
    """`rows` of a table, dealt out anew if the table is too small to be read by all cores: a single row group would be one
    task, however long its texts. Where the session counts large tables as small, a task still gets no more than SHARE. Other
    tables stay as they are read."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes")))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(max(cores, -(-size // SHARE))) if size < cores * least else rows
