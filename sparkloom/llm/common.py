"""What the operators of this subpackage share: tables, written steps, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; each operator states how wide such a row is.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for steps; a temporary one only where a local session names none."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    context = spark.sparkContext
    if not (folder := context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sparkloom-')}")
        folder = context.getCheckpointDir()
    return folder


class Written:
    """A step that was written to the shared folder, so that a lost executor costs no recomputation."""

    listed: list[list] = []

    def __init__(self, df: DataFrame, codec: str = "zstd"):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/steps/{uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        for made in Written.listed:
            made.append(self)

    def drop(self) -> None:
        """For steps that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_steps() -> Iterator[list[Written]]:
    """A list of the steps that are written inside; those still in it at the end are dropped."""
    made: list[Written] = []
    Written.listed.append(made)
    try:
        yield made
    finally:
        Written.listed.remove(made)
        for step in made:
            step.drop()


def written(df: DataFrame) -> DataFrame:
    return Written(df).df


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast of a written table if it has `limit` rows at most; beyond that Spark plans a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with as many underscores before it as no taken name needs; case does not tell names apart."""
    lower = {t.lower() for t in taken}
    while name in lower:
        name = f"_{name}"
    return name


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is held out; one without an identifier is not, nor is it learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def learned(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % folds != 0


def words(text: str) -> Column:
    """Number of maximal runs without ASCII white space; null counts as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
