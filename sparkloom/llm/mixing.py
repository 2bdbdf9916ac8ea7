"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of the mix by weight, at most so many times its own size. Within a source a document's expected
number of copies is in proportion to its weight, at most as many as allowed, and such that the source's words come to its
target. The whole part of that number is certain. For the rest, which is the document's inclusion probability, documents
rank by the odds of a uniform random number divided by their inclusion odds, and the first of a source are taken until they
hold its remaining words. The random number is a digest of the identifier and a seed, so reruns agree on any partitioning.
The cut in a source's order is found from histograms of ranks, each over the bucket that the one before found, so no task
holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, small_side, table, words, written

#: Rows of a source in the bucket of its cut, up to which they are ordered one by one; bits of a rank, and those of a level.
BUCKET_ROWS, RANK_BITS, LEVEL_BITS = 2_000, 48, 12


def uniform(id_col: str, text_col: str, seed: str) -> Column:
    """48 digest bits of an identifier, or else of the text, as a number in (0, 1)."""
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    digest = F.md5(F.concat(key, F.lit(f":{seed}")))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) with target: weights repeat along the sources in code point order, null last.

    All targets sum to `share` of all sizes unless every source is at `most` times its size. A source above that
    stops there and its excess goes to the others by weight, until none is above: sources are at their limit in
    order of limit / weight, which gives the common level in one pass.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy("_full", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("_n") + 1)
    ranked = (
        sizes.withColumn("_n", (F.row_number().over(by_name) - 1) % len(weights)).withColumn("_w", weight)
        .withColumn("_limit", F.lit(float(most)) * F.col("source_size")).withColumn("_full", F.col("_limit") / F.col("_w"))
        .withColumn("_before", F.sum("_limit").over(order) - F.col("_limit"))
        .withColumn("_left", F.sum("_w").over(every) - F.sum("_w").over(order) + F.col("_w"))
        .withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(every) - F.col("_before")) / F.col("_left"))
    )
    # the level is that of the first source which is not at its limit
    level = F.min_by(F.when(F.col("_level") < F.col("_full"), F.col("_level")), F.when(F.col("_level") < F.col("_full"), F.col("_full"))).over(every)
    return ranked.withColumn("_common", level).select("source", "source_size", F.when(F.col("_common").isNull(), F.col("_limit")).otherwise(F.least(F.col("_limit"), F.col("_w") * F.col("_common"))).alias("target"))


def expected_copies(classes: DataFrame, most: float) -> DataFrame:
    """classes (_none, _source, _w, _words, target) with _copies: the expected copies of a document of that weight.

    They are in proportion to the weight, `most` at most, and make the words of a source sum to its target: the classes of
    largest weight are at the limit first, which gives the common factor in one pass.
    """
    order = Window.partitionBy("_none", "_source").orderBy(F.col("_w").desc())
    every = Window.partitionBy("_none", "_source")
    full = F.lit(float(most)) / F.col("_w")
    mass = F.col("_w") * F.col("_words")
    after = F.sum(mass).over(order.rowsBetween(0, Window.unboundedFollowing))
    before = F.coalesce(F.sum(F.lit(float(most)) * F.col("_words")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    factor = F.when(after > 0, (F.col("target") - before) / after)
    open_ = classes.withColumn("_full", full).withColumn("_factor", factor).withColumn("_factor", F.when(F.col("_factor") < F.col("_full"), F.col("_factor")))
    common = F.min_by("_factor", F.when(F.col("_factor").isNotNull(), F.col("_full"))).over(every)
    return open_.withColumn("_common", common).withColumn("_copies", F.when(F.col("_common").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.col("_w") * F.col("_common")))).drop("_full", "_factor", "_common")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
    weight_col: str | None = None, seed: str = "mix-1",
) -> DataFrame:
    """A row for each row of `docs`: its columns but the text, and size, source_size, target, copies and taken (words of the
    mix that it supplies).

    weight_col: relative number of copies within a source, rounded to powers of 2 ** (1 / 8) (1 if null or not positive).
    Without it, a document weighs 1 / (1 + binary digits of its size): a source's words come from more documents than if a
    few very long ones held them. A null text has size 0, a very long one is counted whole; a null source is a source.
    Documents of equal rank are ordered by random number, identifier, then size; repeated rows are rows of their own. An
    empty table gives an empty table. Columns of `docs` named like added ones are replaced; others may have any name.
    Sources are a row each, which one task puts in order.
    """
    docs = docs.drop("size", "source_size", "target", "taken", "copies")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # the operator's own names start with an underscore
    ident, text, source = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    carried = [c for c in plain.columns if c != text]
    count = words(text)
    if weight_col:
        mark = F.col(f"c{names.index(weight_col)}").cast("double")
        weight = F.when(mark > 0, F.pow(F.lit(2.0), F.round(8 * F.log2(mark)) / 8)).otherwise(1.0)
    else:
        weight = 1.0 / (1 + F.length(F.bin("_size")))
    sized = written(
        plain.select(*carried, count.alias("_size"), uniform(ident, text, seed).alias("_u"), F.col(source).isNull().alias("_none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source")).withColumn("_w", F.coalesce(weight, F.lit(1.0)))
    )
    by_source = ["_none", "_source"]
    classes = written(sized.groupBy(*by_source, "_w").agg(F.sum("_size").alias("_words")))
    sums = classes.groupBy(F.when(~F.col("_none"), F.col("_source")).alias("source")).agg(F.sum("_words").alias("source_size"))
    goals = targets(sums, weights, share, most).select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target")
    planned = written(expected_copies(classes.join(goals, by_source), most).withColumn("_certain", F.floor("_copies")).withColumn("_p", F.col("_copies") - F.floor("_copies")))
    remaining = F.col("target") - F.sum(F.col("_certain") * F.col("_words")).over(Window.partitionBy(*by_source))
    planned = written(planned.withColumn("_rest", remaining).drop("_words", "_copies"))
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-12), F.col("_p")))
    ratio = F.col("_u") / (1 - F.col("_u")) * ((1 - p) / p)  # odds of the random number over inclusion odds
    placed = sized.join(small_side(planned), [*by_source, "_w"]).withColumn("_rank", ratio / (1 + ratio)).withColumn("_place", F.floor(F.col("_rank") * float(1 << RANK_BITS)).cast("long"))
    # (_none, _source, _cut: first bits of the rank at the cut, _start: words before them)
    cut, shift = None, RANK_BITS
    while shift > 0:
        rows = placed if cut is None else placed.join(small_side(cut), by_source).filter(F.shiftright("_place", shift) == F.col("_cut"))
        shift -= LEVEL_BITS
        start = F.lit(0) if cut is None else F.col("_start")
        along = Window.partitionBy(*by_source).orderBy("_bucket")
        cut = written(
            rows.groupBy(*by_source, "_rest", start.alias("_before"), F.shiftright("_place", shift).alias("_bucket")).agg(F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_n"))
            .withColumn("_end", F.col("_before") + F.sum("_sum").over(along)).filter(F.col("_end") > F.col("_rest"))
            .groupBy(*by_source).agg(F.min(F.struct("_bucket", (F.col("_end") - F.col("_sum")).alias("s"), "_n")).alias("k")).select(*by_source, F.col("k._bucket").alias("_cut"), F.col("k.s").alias("_start"), F.col("k._n").alias("_n"))
        )
        largest = cut.agg(F.max("_n")).first()[0]
        cut = cut.drop("_n")
        if not largest or largest <= BUCKET_ROWS:
            break
    placed = placed.withColumn("_bucket", F.shiftright("_place", shift)).join(small_side(cut), by_source, "left")
    whole = placed.filter(F.col("_cut").isNull() | (F.col("_bucket") != F.col("_cut"))).withColumn("_in", F.col("_cut").isNull() | (F.col("_bucket") < F.col("_cut")))
    ordered = Window.partitionBy(*by_source).orderBy("_rank", "_u", F.col(ident).asc_nulls_first(), "_size").rowsBetween(Window.unboundedPreceding, 0)
    parted = placed.filter(F.col("_bucket") == F.col("_cut")).withColumn("_end", F.col("_start") + F.sum("_size").over(ordered)).withColumn("_in", 2 * F.col("_end") - F.col("_size") <= 2 * F.col("_rest")).drop("_end")
    copies = (F.col("_certain") + F.when((F.col("_rest") > 0) & (F.col("_certain") < most) & F.col("_in"), 1).otherwise(0)).cast("long")
    made = whole.unionByName(parted).withColumn("_copies", copies).select(*carried, "_size", "source_size", "target", "_copies", (F.col("_copies") * F.col("_size")).alias("taken"))
    return made.toDF(*(n for n in names if n != text_col), "size", "source_size", "target", "copies", "taken")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sized AS (
  SELECT *, 1.0::DOUBLE / (1 + length(bin(size))) AS cw FROM (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || ':mix-1'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
    FROM documents)),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sums),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS filled,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining,
         1.5::DOUBLE * sum(source_size) OVER () AS wanted
  FROM named),
common AS (SELECT min_by((wanted - before) / remaining, filled) AS level FROM levels WHERE (wanted - before) / remaining < filled),
goals AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, w * level) END AS target FROM levels, common),
classes AS (
  SELECT s.source, s.cw, g.source_size, g.target, s.n, 2.0::DOUBLE / s.cw AS filled,
         coalesce(sum(2.0::DOUBLE * s.n) OVER (PARTITION BY s.source ORDER BY s.cw DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
         sum(s.cw * s.n) OVER (PARTITION BY s.source ORDER BY s.cw DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining
  FROM (SELECT source, cw, sum(size)::BIGINT AS n FROM sized GROUP BY source, cw) s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
factors AS (
  SELECT source, min_by((target - before) / remaining, filled) AS factor FROM classes WHERE remaining > 0 AND (target - before) / remaining < filled GROUP BY source),
planned AS (
  SELECT c.source, c.cw, c.source_size, c.target, c.n, CASE WHEN f.factor IS NULL THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, c.cw * f.factor) END AS expected
  FROM classes c LEFT JOIN factors f ON c.source IS NOT DISTINCT FROM f.source),
rest AS (SELECT *, target - sum(floor(expected) * n) OVER (PARTITION BY source) AS wanted, least(1 - 1e-9, greatest(1e-12, expected - floor(expected)))::DOUBLE AS p FROM planned),
ranked AS (
  SELECT s.doc_id, s.source, s.size, s.u, r.source_size, r.target, r.wanted, floor(r.expected) AS certain, (s.u / (1 - s.u)) * ((1 - r.p) / r.p) AS ratio
  FROM sized s JOIN rest r ON s.source IS NOT DISTINCT FROM r.source AND s.cw = r.cw),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ratio / (1 + ratio), u, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM ranked)
SELECT doc_id, size, source_size, target,
       (size * (certain + CASE WHEN wanted > 0 AND certain < 2 AND 2 * upto - size <= 2 * wanted THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
