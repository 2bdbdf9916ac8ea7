"""Dropping lines that many documents repeat, by a sharded minimal perfect hash.

The distinct lines' hashes are dealt to shards, each of which holds about SHARD_LINES of them. A shard is a minimal perfect
hash (perfect_hash.py) and arrays by its slots: a fingerprint of 32 bits, the number of documents up to the threshold, and,
for lines at the threshold, the largest identifier. Documents then probe these arrays: a probe is the hash of a line and its
document's number, and streams past the arrays of its shard in any order; lines themselves are neither joined nor shuffled.
Counts are summed for each batch of documents before they are dealt out. A shard that a frequent line fills with probes is
copied to several tasks, each with a part of the probes, since its arrays are small.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..steps import spread
from .common import Written, shuffle_partitions, small_side, table
from .keyed import and_end
from .perfect_hash import PerfectHash
from .terms import in_slices

LEAST_DOCS, LEAST_CHARS = 3, 20
#: Lines of a shard in the mean, and probes that go to one copy of it.
SHARD_LINES, PART_PROBES = 1 << 18, 1 << 20
#: Stands for no identifier, which comes before all others.
NONE = -(1 << 63)


def line_keys(text: bytes, least_chars: int) -> list[bytes | None]:
    """A digest of 16 bytes for each line; none if its key is too short. A key is the line without ASCII white space at its
    ends, A-Z in lower case."""
    found: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip().lower()  # of bytes: ASCII only
        n = len(key)
        if n >= least_chars and not key.isascii():
            n = len(key.decode("utf-8", "replace"))
        found.append(xxhash.xxh3_128_digest(key) if n >= least_chars else None)
    return found


def distinct_keys(texts: pa.Array, least_chars: int) -> tuple[list[bytes], list[int]]:
    """The distinct digests of each text, one after another, and how many each has."""
    digests, sizes = [], []
    for text in texts:
        own = set(line_keys(text.as_py() or b"", least_chars)) - {None}
        digests += own
        sizes.append(len(own))
    return digests, sizes


def halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def summed(high: np.ndarray, low: np.ndarray, count: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each key: counts are summed, the largest owner stays."""
    order = np.lexsort((low, high))
    high, low, count, owner = high[order], low[order], count[order], owner[order]
    first = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(high) else np.empty(0, np.int64)
    if not len(first):
        return high, low, count, owner
    return high[first], low[first], np.add.reduceat(count, first), np.maximum.reduceat(owner, first)


class Shard:
    """Fingerprints, counts and owners of a shard's lines, by slot."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray, least: int):
        self.hash, self.prints, self.counts, self.owners, self.least = PerfectHash(sizes, words), prints, counts, owners, int(least)
        self.owner_at = np.cumsum(counts >= self.least) - 1

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, count: np.ndarray, owner: np.ndarray, least: int) -> Shard:
        own = PerfectHash.of(high, low)
        by_slot = np.argsort(own.slots(high, low))
        count = np.minimum(count, least)[by_slot].astype(np.min_scalar_type(least))  # more is not asked for
        return cls(own.sizes, own.words, (low >> np.uint64(32)).astype("<u4")[by_slot], count, owner[by_slot][count >= least], least)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.hash.sizes, words=self.hash.words, prints=self.prints, counts=self.counts, owners=self.owners, least=self.least)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        return cls(**np.load(io.BytesIO(raw)))

    def dropped(self, high: np.ndarray, low: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Which lines of documents `owner` are at the threshold and stay in another document."""
        slot = self.hash.slots(high, low)
        at = np.maximum(slot, 0)
        hit = slot >= 0
        if len(self.prints):
            hit &= (self.prints[at] == (low >> np.uint64(32)).astype("<u4")) & (self.counts[at] >= self.least)
            hit[hit] = self.owners[self.owner_at[at[hit]]] != owner[hit]
        return hit


def _rows(columns: dict[str, np.ndarray | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype.itemsize == 8 else c) for c in columns.values()], names=list(columns))


def line_index(texts: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, shard_lines: int = SHARD_LINES) -> tuple[DataFrame, int]:
    """A table (shard, probes, arrays) over the lines of texts (id: long, body: binary), and the number of shards. probes:
    the number of pairs of a line and a document."""
    spark = texts.sparkSession
    chars = F.coalesce(F.length("body") - F.length(F.replace(F.col("body").cast("string"), F.lit("\n"), F.lit("")).cast("binary")), F.lit(0)) + 1
    shards = max(1, -(-(texts.agg(F.sum(chars)).first()[0] or 0) // shard_lines))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes = distinct_keys(batch.column(1), least_chars)
            owner = np.repeat(batch.column(0).fill_null(NONE).to_numpy(), sizes)
            high, low, n, owner = summed(*halves(digests), np.ones(len(digests), np.int64), owner)
            yield _rows({"shard": (high % np.uint64(shards)).astype(np.int64), "high": high, "low": low, "n": n, "owner": owner})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, rows = None, [], 0
        for batch in and_end(batches):
            data = np.stack([c.to_numpy() for c in batch.columns]) if batch is not None else np.empty((5, 0), np.int64)
            cuts = np.flatnonzero(np.r_[True, data[0, 1:] != data[0, :-1], True]) if data.shape[1] else []
            runs = [(int(data[0, x]), data[1:, x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            for shard, own in [*runs, *([(None, None)] if batch is None else [])]:
                if shard != held and parts:
                    high, low, n, owner = _joined(parts)
                    yield _rows({"shard": [held], "probes": [int(n.sum())], "arrays": pa.array([Shard.of(high, low, n, owner, least_docs).to_bytes()], pa.binary())})
                    parts, rows = [], 0
                held = shard
                if own is not None:
                    parts.append(own)
                    rows += own.shape[1]
                    if rows > 4 * shard_lines:  # frequent lines come once a batch
                        high, low, n, owner = _joined(parts)
                        parts, rows = [np.stack([high.view(np.int64), low.view(np.int64), n, owner])], 0

    counted = texts.mapInArrow(count, "shard long, high long, low long, n long, owner long")
    dealt = counted.repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard")
    return Written(dealt.mapInArrow(build, "shard long, probes long, arrays binary")).df, shards


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    high, low, n, owner = np.concatenate(parts, axis=1)
    return summed(high.view(np.uint64), low.view(np.uint64), n, owner)


def repeated_lines(texts: DataFrame, index: DataFrame, shards: int, least_chars: int = LEAST_CHARS, part_probes: int = PART_PROBES) -> DataFrame:
    """(place, id, line): first halves of the hashes of lines that a document loses. texts: (id, body, place)."""
    spark = texts.sparkSession

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes = distinct_keys(batch.column(1), least_chars)
            high, low = halves(digests)
            of = np.repeat(np.arange(batch.num_rows), sizes)
            yield _rows({"shard": (high % np.uint64(shards)).astype(np.int64), "high": high, "low": low, "id": batch.column(0).take(pa.array(of)), "place": batch.column(2).take(pa.array(of))})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            loads = np.flatnonzero(batch.column(5).is_valid().to_numpy(zero_copy_only=False)).tolist()
            for start, stop in zip([-1, *loads], [*loads, batch.num_rows], strict=True):
                if start >= 0:
                    shard = Shard.from_bytes(batch.column(5)[start].as_py())
                part = batch.slice(start + 1, stop - start - 1)
                if part.num_rows:
                    high, low = (part.column(i).to_numpy().view(np.uint64) for i in (0, 1))
                    hit = pa.array(shard.dropped(high, low, part.column(2).fill_null(NONE).to_numpy()))
                    yield pa.RecordBatch.from_arrays([part.column(i).filter(hit) for i in (3, 2, 0)], names=["place", "id", "line"])

    sent = texts.mapInArrow(probes, "shard long, high long, low long, id long, place long")
    copies = index.withColumn("parts", F.ceil(F.col("probes") / part_probes))
    sent = sent.join(small_side(copies.filter("parts > 1").select("shard", "parts")), "shard", "left").select("shard", F.pmod("place", F.coalesce("parts", F.lit(1))).alias("part"), "high", "low", "id", "place", F.lit(None).cast("binary").alias("arrays"))
    none = F.lit(None).cast("long")
    kept = copies.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), none.alias("high"), none.alias("low"), none.alias("id"), none.alias("place"), "arrays")
    # a shard's arrays come before its probes
    dealt = kept.unionByName(sent).repartition(shuffle_partitions(spark), "shard", "part").sortWithinPartitions("shard", "part", F.col("arrays").isNull())
    return dealt.select("high", "low", "id", "place", "part", "arrays").mapInArrow(probe, "place long, id long, line long")


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, shard_lines: int = SHARD_LINES, part_probes: int = PART_PROBES
) -> DataFrame:
    """`docs` with its texts without repeated lines, and n_lines (before) and n_dropped.

    Lines end at \\n. A line whose key (without ASCII white space at its ends, A-Z in lower case) has at least `least_chars`
    characters and is in at least `least_docs` rows stays only in rows with the largest identifier that holds it, there as
    often as it comes. Null and empty texts are one empty line; very long texts are read line by line; a row without an
    identifier comes before all others, and repeated rows count as rows each and lose the same lines. An empty table gives
    an empty table. Identifiers are whole numbers. Columns named like added ones are replaced; others may have any name.
    Lines are told apart by hashes of 128 bits.
    """
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} holds no whole numbers")
    docs = docs.drop("n_lines", "n_dropped")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    ident, text = f"c{docs.columns.index(id_col)}", f"c{docs.columns.index(text_col)}"
    body, place = F.col(text).cast("string").cast("binary"), F.xxhash64(ident, text)
    own = plain.select(F.col(ident).cast("long").alias("id"), body.alias("body"), place.alias("place"))
    index, shards = line_index(own.select("id", "body"), least_docs, least_chars, shard_lines)
    hits = repeated_lines(own, index, shards, least_chars, part_probes).groupBy("place", "id").agg(F.collect_set("line").alias("lines"))
    others = [c for c in plain.columns if c != text]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 0):
            texts, before, gone = [], [], []
            for raw, lines in zip(batch.column(0), batch.column(1), strict=True):
                whole = raw.as_py() or b""
                drop = set(lines.as_py() or ())
                split = whole.split(b"\n")
                stay = split
                if drop:
                    stay = [line for line, key in zip(split, line_keys(whole, least_chars), strict=True) if key is None or int.from_bytes(key[:8], "little", signed=True) not in drop]
                texts.append(b"\n".join(stay))
                before.append(len(split))
                gone.append(len(split) - len(stay))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(before, pa.int64()), pa.array(gone, pa.int64()), *batch.columns[2:]], names=["_kept", "_lines", "_gone", *others])

    joined = plain.withColumn("_place", place).join(hits.hint("merge"), (F.col("_place") == F.col("place")) & F.col(ident).cast("long").eqNullSafe(F.col("id")), "left").select(body.alias("_body"), F.col("lines"), *others)
    made = joined.mapInArrow(keep, StructType([StructField("_kept", BinaryType()), StructField("_lines", LongType()), StructField("_gone", LongType()), *(plain.schema[c] for c in others)]))
    return made.select(*(F.col("_kept").cast("string").alias(text) if c == text else c for c in plain.columns), "_lines", "_gone").toDF(*docs.columns, "n_lines", "n_dropped")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
hot AS (SELECT key, max(doc_id) AS owner FROM (SELECT DISTINCT doc_id, key FROM lines WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3),
marked AS (SELECT l.doc_id, i, line, owner IS NOT NULL AND owner <> l.doc_id AS gone FROM lines l LEFT JOIN hot USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
