"""SimHash fingerprints and near-duplicate classes with pigeonring filtering.

64 bits are cut into distance + 1 segments in a ring. If two fingerprints differ in at most `distance` bits, then
from some segment on, every chain of l consecutive segments differs in at most l * distance / (distance + 1) bits,
rounded down: l - 1. So the first segment of the chain is equal and the first two differ in one bit at most. Pairs
meet by equality on a key of those two segments; rows of odd parity put one flipped bit into the second segment, rows
of even parity wait there. The longer chains are checked before the full distance.

Equal fingerprints are one node. Within a key, only a forest of links is emitted, not all pairs; keyed.py says how keys
with more than a block of fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..steps import spread
from .common import Written, free_name, table
from .components import components
from .keyed import links_within_keys

SHINGLES_AT_ONCE = 1 << 18
#: Fingerprints of one key that are compared in one piece.
BLOCK = 4096


def majority(hashes: Iterator[np.ndarray], n: int) -> int:
    """The 64 bits that are set in over half of n hashes, which come in parts."""
    counts = np.zeros(64, np.int64)
    for part in hashes:
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half the hashes of all word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    last = max(1, len(words) - width + 1)
    starts = range(0, last, SHINGLES_AT_ONCE)
    return majority((np.array([hash_of(b" ".join(words[i : i + width]), seed) for i in range(s, min(last, s + SHINGLES_AT_ONCE))], np.uint64) for s in starts), last)


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """`docs` without the text, with fp (the fingerprint as a signed long). Null and blank texts have fingerprint 0."""
    kept = [c for c in docs.columns if c not in (text_col, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(0)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), *batch.columns[1:]], names=["fp", *kept])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] if kept else []
    return docs.select(F.col(text_col).cast("string").alias(free_name("_text", kept)), *kept).mapInArrow(run, ", ".join(["fp long", *fields]))


class Ring:
    """Segments of the 64 bits, and the keys and chain checks of each start."""

    def __init__(self, distance: int):
        if not 2 <= distance <= 15:
            raise ValueError("distance is 2 to 15")
        self.distance, m = distance, distance + 1
        edges = [64 * i // m for i in range(m + 1)]
        self.segments = [(edges[i], edges[i + 1] - edges[i]) for i in range(m)]
        bits = [((1 << w) - 1) << s for s, w in self.segments]
        #: For each start the masks of the chains of length 1, 2, ... (as many bits less one may differ).
        self.chains = [[np.uint64(sum(bits[(i + j) % m] for j in range(n))) for n in range(1, m + 1)] for i in range(m)]

    def keyed(self, nodes: DataFrame, fp: str = "fp") -> DataFrame:
        """(key, fp): the exact key of each start, and one that allows for one flipped bit in the second segment."""
        parts = []
        for i, (s, w) in enumerate(self.segments):
            s2, w2 = self.segments[(i + 1) % len(self.segments)]
            one = f"(shiftrightunsigned({fp}, {s}) & {(1 << w) - 1}L)"
            two = f"(shiftrightunsigned({fp}, {s2}) & {(1 << w2) - 1}L)"
            head = f"(shiftleft({i}L, 56) | shiftleft({one}, 24)"
            parts.append(f"array({head} | shiftleft({two}, 1)))")
            flips = f"array({', '.join(f'{1 << b}L' for b in range(w2))})"
            parts.append(f"transform(if(bit_count({two}) % 2 = 0, array(0L), {flips}), f -> {head} | shiftleft({two} ^ f, 1) | 1L))")
        return nodes.select(F.expr(f"explode(concat({', '.join(parts)}))").alias("key"), F.col(fp).alias("fp"))

    def linked(self, x: np.ndarray, y: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        """Whether x and y pass every chain from their start on; the last chain is the whole fingerprint."""
        differ = x ^ y
        ok = np.ones(differ.shape, bool)
        for n in range(len(self.segments)):
            mask = np.array([c[n] for c in self.chains])[start]
            ok &= np.bitwise_count(differ & mask) <= (n if n < len(self.segments) - 1 else self.distance)
        return ok


def links(nodes: DataFrame, distance: int = 4, block: int = BLOCK) -> DataFrame:
    """A table of links (a, b) between distinct fingerprints `fp` that keeps every connection of the graph of all pairs
    with at most `distance` differing bits; each of its links is such a pair."""
    ring = Ring(distance)

    def judge(x: np.ndarray, y: np.ndarray, key: np.ndarray | int) -> np.ndarray:
        return ring.linked(x[0].view(np.uint64), y[0].view(np.uint64), key >> 56)

    return links_within_keys(ring.keyed(nodes).withColumnRenamed("fp", "node"), judge, block)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 4, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """A row for each row of `docs`: its columns but the text, fp, class_fp, and component_id: the smallest identifier
    among all rows that are reachable over fingerprints with at most `distance` differing bits, itself included.
    class_fp is one fingerprint of the class, the same for all of it.

    Null and blank texts have fingerprint 0 and link like others. Rows without an identifier belong to classes but
    name none (component_id is null if no row of a class has one). An empty table gives an empty table.
    """
    printed = Written(fingerprints(docs.drop("component_id", "class_fp"), text_col, width, seed)).df
    nodes = Written(printed.groupBy("fp").agg(F.min(id_col).alias("least"))).df
    members = Written(components(links(nodes, distance, block))).df.withColumnRenamed("node", "fp")
    rooted = nodes.join(members, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", F.col("root").alias("class_fp"), "component_id")
    return printed.join(Written(named).df, "fp")


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, width: int = 4) -> DataFrame:
    """Rows of `docs`, unchanged: of each class the row with the smallest identifier (null only if the class has no
    other), and of equal identifiers the one with the smallest hash of its text. Rows alike in both are copies of one
    another, which exact deduplication drops, and stay together."""
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keys = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), hashed.alias("_hash"))
    classes = near_classes(keys, "_id", "_text", distance, width)
    stay = Written(classes.groupBy("class_fp").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_hash")).alias("k")).select("k._id", "k._hash")).df
    ident, own = free_name("_id", docs.columns), free_name("_hash", docs.columns)
    stay = stay.withColumnsRenamed({"_id": ident, "_hash": own})
    return docs.join(stay, F.col(id_col).eqNullSafe(F.col(ident)) & (hashed == F.col(own)), "left_semi")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return near_classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
