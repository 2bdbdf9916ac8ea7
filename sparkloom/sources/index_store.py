"""An index on disk: tables partitioned by shard, published by a marker that names their folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .records import PROTECTED, guarded

VERSION, MARKER = "3", "_VALID"
BY_SHARD = ("postings", "vectors", "keywords", "graph", "members")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_index(path: str, tables: Mapping[str, DataFrame], meta: Mapping[str, object], protected=PROTECTED) -> None:
    """Tables go to a new folder, to which the marker is then switched: a reader sees the old index or the new one, and a
    build that fails leaves the old one as it was. Documents of `members` must be those of `documents`, if both are given."""
    spark = next(iter(tables.values())).sparkSession
    guarded(path, protected)
    folder = f"build-{uuid.uuid4().hex}"
    fs, marker = _path(spark, f"{path}/{MARKER}")
    counts = {}
    for name, df in tables.items():
        writer = df.write
        (writer.partitionBy("shard_id") if name in BY_SHARD and "shard_id" in df.columns else writer).parquet(f"{path}/{folder}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{folder}/{name}").count()
    if {"documents", "members"} <= set(counts) and counts["documents"] != counts["members"]:
        fs.delete(_path(spark, f"{path}/{folder}")[1], True)
        raise ValueError(f"{counts['documents']} documents but {counts['members']} members")
    before = json.loads(_read(fs, marker)).get("folder") if fs.exists(marker) else None
    record = json.dumps({"version": VERSION, "counts": counts, "folder": folder, **meta}, sort_keys=True)
    made = _path(spark, f"{path}/{MARKER}.{folder}")[1]
    out = fs.create(made, True)
    out.write(bytearray(record.encode()))
    out.close()
    fs.delete(marker, False)
    if not fs.rename(made, marker):
        raise OSError(f"{path} could not be published")
    if before:
        fs.delete(_path(spark, f"{path}/{before}")[1], True)


def read_meta(spark: SparkSession, path: str) -> dict:
    fs, marker = _path(spark, f"{path}/{MARKER}")
    if not fs.exists(marker):
        raise FileNotFoundError(f"{path} is not a finished index")
    meta = json.loads(_read(fs, marker))
    if meta.get("version") != VERSION:
        raise ValueError(f"index of version {meta.get('version')!r}; {VERSION!r} is needed")
    return meta


def _read(fs, marker) -> str:
    stream = fs.open(marker)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a finished index. A filter on shard_id reads only the folders of those shards."""
    meta = read_meta(spark, path)
    return {name: spark.read.parquet(f"{path}/{meta['folder']}/{name}") for name in meta["counts"]}
