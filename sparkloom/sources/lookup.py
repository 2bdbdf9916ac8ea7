"""Tables from which few records are read by their identifiers.

Records lie in order of a digest of the identifier, in small row groups with a Bloom filter of it. A lookup asks for digests,
so that the reader skips every row group whose range or filter does not have one; the identifiers are compared in full after.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import PROTECTED, guarded

DIGEST = "_digest"
#: Bytes of a row group, and identifiers of one lookup that are pushed into the reader; more are joined.
GROUP_BYTES, PUSHED = 1 << 20, 200


def write_lookup(records: DataFrame, path: str, key: str, group_bytes: int = GROUP_BYTES, group_rows: int = 100_000, protected: Sequence[str] = PROTECTED) -> None:
    """`records` at `path`, ordered by a digest of `key`. A record whose identifier is null cannot be looked up."""
    if DIGEST in records.columns:
        raise ValueError(f"{DIGEST} is the name of a column of its own")
    own = records.withColumn(DIGEST, F.xxhash64(key)).repartitionByRange(DIGEST).sortWithinPartitions(DIGEST)
    own.write.mode("overwrite").option("parquet.block.size", group_bytes).option("parquet.block.row.count.limit", group_rows).option(f"parquet.bloom.filter.enabled#{DIGEST}", "true").option(
        f"parquet.bloom.filter.expected.ndv#{DIGEST}", group_rows
    ).parquet(guarded(path, protected))


def look_up(spark: SparkSession, path: str, key: str, ids: Sequence) -> DataFrame:
    """The records of `ids` with pos, the place of an identifier's first mention; identifiers without a record are left out
    (see absent). The order of the rows is that of pos where the caller sorts by it."""
    table = spark.read.parquet(path)
    kind = table.schema[key].dataType.simpleString()
    first = {i: p for p, i in reversed(list(enumerate(ids))) if i is not None}
    wanted = spark.createDataFrame([(i, p) for i, p in first.items()], f"_id {kind}, pos int")
    rows = table
    if first and len(first) <= PUSHED:
        digests = [r[0] for r in wanted.select(F.xxhash64("_id")).collect()]
        rows = rows.filter(reduce(lambda a, b: a | b, (F.col(DIGEST) == d for d in digests)))
    return rows.join(F.broadcast(wanted) if len(first) <= 100_000 else wanted, (F.col(DIGEST) == F.xxhash64("_id")) & (F.col(key) == F.col("_id"))).drop("_id", DIGEST)


def absent(spark: SparkSession, path: str, key: str, ids: Sequence) -> list:
    """The identifiers that have no record, in the order they were asked for, each once. They are held on the driver, as `ids` are."""
    found = {r[0] for r in look_up(spark, path, key, ids).select(key).collect()}
    return [i for i in dict.fromkeys(ids) if i not in found]
