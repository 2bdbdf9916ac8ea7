"""Raw rows to documents: mapping, validation, selection, merging, referential checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, derive_title, record_id


def mapped_rows(rows: DataFrame, field_map: Mapping[str, str], prefix: str, least_chars: int = 32, order_by: str | None = None, language: str | None = None) -> DataFrame:
    """normalize_rows row by row: rows with one identifier all stay, with _order to choose by. Takes streams too."""
    if field_map["text"] not in rows.columns:
        raise ValueError(f"no column {field_map['text']!r} for text")
    given = {k: clean(F.col(v)) for k, v in field_map.items() if v in rows.columns}
    rest = [c for c in rows.columns if c not in field_map.values() and c != order_by]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    metadata = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    text, url = given["text"], F.nullif(given.get("url", F.lit("")), F.lit(""))
    title = F.nullif(given.get("title", F.lit("")), F.lit(""))
    return rows.select(
        record_id(prefix, F.coalesce(url, text)).alias("id"), F.coalesce(title, derive_title(text)).alias("title"), text.alias("text"), url.alias("url"),
        F.nullif(given.get("language", F.lit(language or "")), F.lit("")).alias("language"), metadata.alias("metadata"), (F.col(order_by) if order_by else text).alias("_order"),
    ).filter(F.length("text") >= least_chars)


def normalize_rows(rows: DataFrame, field_map: Mapping[str, str], prefix: str, least_chars: int = 32, order_by: str | None = None, language: str | None = None) -> DataFrame:
    """Documents (id, title, text, url, language, metadata) from rows whose columns `field_map` names for text, title,
    url and language; the others become metadata.

    Text is cleaned and shorter ones dropped; the identifier is a digest of the url, or else of the text. Of rows with
    one identifier the first in `order_by` stays (or the smallest text). Result in order of identifier is left to
    the caller.
    """
    made = mapped_rows(rows, field_map, prefix, least_chars, order_by, language)
    first = Window.partitionBy("id").orderBy("_order", "text")
    return made.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "_order")


def violations(docs: DataFrame) -> DataFrame:
    """(id, reason) of rows that break a rule: blank identifier, title or text, or a repeated identifier."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    reasons = F.array_compact(F.array(F.when(blank("id"), "blank id"), F.when(blank("title"), "blank title"), F.when(blank("text"), "blank text")))
    own = docs.select(F.col("id").cast("string").alias("id"), F.explode(reasons).alias("reason"))
    repeated = docs.groupBy(F.col("id").cast("string").alias("id")).count().filter("count > 1").select("id", F.lit("repeated id").alias("reason"))
    return own.unionByName(repeated)


def require_valid(docs: DataFrame) -> DataFrame:
    """`docs`, or an error that names the first violation."""
    if bad := violations(docs).orderBy("id", "reason").limit(1).collect():
        raise ValueError(f"document {bad[0]['id']!r}: {bad[0]['reason']}")
    return docs


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def matches(languages: Sequence[str] | None = None, published_from=None, published_to=None, metadata_equals: Mapping[str, str | None] | None = None, published: str = "published_at") -> Column:
    """A condition on documents, all parts of which hold: language among some, published from (inclusive) and to
    (exclusive), metadata equal. A null language or date fails; a missing key equals null."""
    parts = [F.lit(True)]
    if languages is not None:
        parts.append(F.coalesce(F.col("language").isin(*languages), F.lit(False)) if languages else F.lit(False))
    if published_from is not None:
        parts.append(F.coalesce(F.col(published) >= F.lit(published_from), F.lit(False)))
    if published_to is not None:
        parts.append(F.coalesce(F.col(published) < F.lit(published_to), F.lit(False)))
    for key, value in (metadata_equals or {}).items():
        parts.append(F.col("metadata")[key].eqNullSafe(F.lit(value)))
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def select_documents(docs: DataFrame, condition: Column, most: int | None = None, ident: str = "id") -> DataFrame:
    """Those that match, in order of identifier, `most` of them at most."""
    chosen = docs.filter(condition).orderBy(ident)
    return chosen if most is None else chosen.limit(most)


def merge(first: DataFrame, second: DataFrame, ident: str = "id") -> DataFrame:
    """The union; of one identifier the row of the first source stays."""
    return first.unionByName(second.join(first.select(ident).distinct(), ident, "left_anti"), allowMissingColumns=True).dropDuplicates([ident])


def missing_references(refs: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    return refs.select(key).distinct().join(docs.select(key), key, "left_anti")


def require_references(refs: DataFrame, docs: DataFrame, key: str, shown: int = 20) -> DataFrame:
    if absent := missing_references(refs, docs, key).orderBy(key).limit(shown).collect():
        raise ValueError(f"documents that do not exist: {', '.join(str(r[0]) for r in absent)}")
    return refs


def judged_topics(topics: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, question, positive, negative): topics with judgments, and their documents by grade."""
    grouped = qrels.groupBy("query_id").agg(F.sort_array(F.collect_set(F.when(F.col("grade") > 0, F.col("doc_id")))).alias("positive"), F.sort_array(F.collect_set(F.when(F.col("grade") <= 0, F.col("doc_id")))).alias("negative"))
    return topics.join(grouped, "query_id")
