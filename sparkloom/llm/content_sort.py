"""Exact deduplication by sorting content, with DataFrame functions only.

Splitters are sampled from the rows and deal the texts out by range of their bytes; each range is sorted externally by its
texts' bytes, which places equal texts side by side, and neighbours are compared in full. A splitter is the shortest prefix
that tells its sampled text from the one before it. Where texts agree on the first PREFIX characters (copies, boilerplate),
their hash and then the identifier go on, so that a text with very many copies spreads over as many ranges as its rows need.
Only texts at such a splitter can lie in more than one range; their counts (a row for each range at most) are summed apart
and joined back.
"""

from __future__ import annotations

import json
import math
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

#: Rows sampled for each range, in the mean, and characters of each that reach the driver.
SAMPLE_PER_RANGE, PREFIX = 20, 256
LEAST_HASH = -(1 << 63)


def splitters(keyed: DataFrame, ranges: int, seed: int = 7) -> list[tuple]:
    """At most ranges - 1 increasing keys (prefix, hash, identifier); the driver holds about SAMPLE_PER_RANGE keys a range.
    keyed: (_key)."""
    rows = keyed.count()
    if ranges < 2 or rows == 0:
        return []
    share = min(1.0, SAMPLE_PER_RANGE * ranges / rows)
    sampled = (keyed if share == 1.0 else keyed.sample(share, seed)).select("_key.*").limit(4 * SAMPLE_PER_RANGE * ranges).collect()
    order = lambda k: (k[0].encode("utf-8", "surrogatepass"), k[1], k[2] is not None, k[2])
    keys = sorted((tuple(r) for r in sampled), key=order)
    found = []
    for at in sorted({max(1, i * len(keys) // ranges) for i in range(1, ranges)}):
        if at < len(keys) and keys[at] != keys[at - 1]:
            before, own = keys[at - 1][0], keys[at][0]
            same = next((i for i, (x, y) in enumerate(zip(before, own, strict=False)) if x != y), min(len(before), len(own)))
            found.append(keys[at] if before == own else (own[: same + 1], LEAST_HASH, None))
    assert all(order(x) < order(y) for x, y in pairwise(found))
    return found


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", partitions: int | None = None) -> DataFrame:
    """All rows of `docs` with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical; null counts as empty. keep: whether the row with the "smallest" or the "largest"
    identifier stays. Rows without an identifier stay only if no row of their group has one. Of rows repeated with
    their identifier one stays. Very long texts are compared in full like others. An empty table gives an empty table.
    Columns of `docs` that have the names of added ones are replaced; others may have any name.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession
    ranges = partitions or shuffle_partitions(spark)
    kind = docs.schema[id_col].dataType
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # the operator's own names start with an underscore
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = plain.withColumn("_hash", F.xxhash64(body)).withColumn("_key", F.struct(F.substring(body, 1, PREFIX).alias("p"), F.col("_hash").alias("h"), F.col(ident).alias("i")))
    cuts = splitters(keyed.select("_key"), ranges)
    chosen = F.max if keep == "largest" else F.min
    edge, range_of = F.lit(False), F.lit(0)
    if cuts:
        # one literal each for the plan; a search in two levels compares a row with about twice the root of all splitters
        step = math.isqrt(len(cuts) - 1) + 1
        one = f"struct<p:string,h:bigint,i:{kind.simpleString()}>"
        as_json = [{"p": p, "h": h, "i": i if i is None or isinstance(i, (int, float, str)) else str(i)} for p, h, i in cuts]
        value = lambda rows, of: F.from_json(F.lit(json.dumps(rows)), of)
        groups = value([as_json[i : i + step] for i in range(0, len(cuts), step)], f"array<array<{one}>>")
        firsts, every = value(as_json[::step], f"array<{one}>"), value(as_json, f"array<{one}>")
        at_or_below = lambda some, key: F.size(F.filter(some, lambda s: s <= key))
        keyed = keyed.withColumn("_group", at_or_below(firsts, F.col("_key")))
        range_of = F.when(F.col("_group") == 0, 0).otherwise((F.col("_group") - 1) * step + at_or_below(F.element_at(groups, F.greatest(F.col("_group"), F.lit(1))), F.col("_key")))
        here = lambda c: (c["p"] == F.col("_key.p")) & (c["h"] == F.col("_hash"))
        at = lambda i: F.coalesce(here(F.get(every, i)), F.lit(False))
        edge = at(F.col("_range") - 1) | at(F.col("_range"))
    dealt = keyed.withColumn("_range", range_of.cast("int")).withColumn("_edge", edge)

    # sorted by range and bytes; equal neighbours are a run
    run = Window.partitionBy("_range", "_body")
    newest = F.col(ident).desc_nulls_last() if keep == "largest" else F.col(ident).asc_nulls_last()
    compared = (
        dealt.drop("_key", "_group").repartitionById(len(cuts) + 1, F.col("_range")).withColumn("_body", body)
        .withColumn("_at", F.row_number().over(run.orderBy(newest)))
        .withColumn("_size", F.count(F.lit(1)).over(run)).withColumn("_keep", chosen(ident).over(run))
        .withColumn("_sha", F.sha2(F.col("_body"), 256))
    )
    if cuts:
        # at most a row for each splitter: its hash, its digest, three numbers
        total = (
            dealt.filter("_edge").withColumn("_s", F.sha2(body, 256)).groupBy(F.col("_hash").alias("_h"), "_s")
            .agg(F.count(F.lit(1)).alias("_all"), chosen(ident).alias("_best"), F.min("_range").alias("_lo"), chosen(F.when(F.col(ident).isNotNull(), F.col("_range"))).alias("_held"))
        )
        compared = compared.join(F.broadcast(total), (F.col("_h") == F.col("_hash")) & (F.col("_s") == F.col("_sha")) & F.col("_edge"), "left")
        keep_id, size = F.when(F.col("_all").isNotNull(), F.col("_best")).otherwise(F.col("_keep")), F.coalesce("_all", "_size")
        mine = F.col("_range") == F.coalesce("_held", "_lo", "_range")
    else:
        keep_id, size, mine = F.col("_keep"), F.col("_size"), F.lit(True)
    kept = (F.col("_at") == 1) & F.col(ident).eqNullSafe(keep_id) & mine
    return compared.select(*plain.columns, keep_id, size.cast("long"), kept, "_sha").toDF(*names, "keep_id", "group_size", "kept", "text_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
