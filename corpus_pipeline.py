"""A training corpus from raw documents: language, exact copies, near copies, mix, token sequences.

Each stage is a function of (spark, docs, sf_dir) and takes what its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import content_sort, language, mixing, near_copies, packing
from sparkloom.llm.common import Written, passing_steps, table

#: A text whose letters are less than this share in known scripts and its own language is rejected.
LEAST_LANGUAGE_SCORE = 0.2
#: A text further from the labelled texts of its language is in none of them. Of the odd half of sf0.1, scored by a model
#: of the even half, three texts, mostly secret tokens, are at 0.52 to 0.54 and all others below 0.26. Dutch is at 0.67
#: there and at 0.55 in a model of sf0.01, Italian and letter noise above.
MOST_MISFIT = 0.4


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns named by position, so that none clashes with a stage's own; and these names."""
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts in none of the learned languages. Empty and null texts go; repeated rows and
    very long texts are like others; without any labelled row nothing is known, and all rows go; an empty table gives an empty table."""
    plain, of = _plain(docs)
    model = language.fit(plain, of["doc_id"], of["text"], of["lang"])
    found = language.identify(plain, model, of["text"], misfit=True)
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE) & (F.col("misfit") <= MOST_MISFIT)
    return found.filter(known).select(*plain.columns).toDF(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null being empty, the row with the largest doc_id stays; of rows repeated with it one. Very long texts
    are compared whole; an empty table gives an empty table."""
    plain, of = _plain(docs)
    return content_sort.exact_dedup(plain, of["doc_id"], of["text"], keep="largest").filter("kept").select(*plain.columns).toDF(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts linked by a five-word Jaccard similarity of 0.8 or more, the row with the smallest doc_id stays
    (a null one only where there is no other). Null and empty texts are one class; rows alike in doc_id and text stay; very
    long texts are compared whole; an empty table gives an empty table."""
    plain, of = _plain(docs)
    return near_copies.one_of_each_class(plain, of["doc_id"], of["text"]).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: not at all, once or twice. Null and empty texts have no words and are taken
    as often as other texts of their source and size; a null source is a source; ties go by doc_id; very long texts count
    with all their words; repeated rows are rows each; an empty table gives an empty table."""
    plain, of = _plain(docs)
    weighed = mixing.mix(plain.withColumn("_body", F.col(of["text"])), of["doc_id"], of["text"], of["source"])  # mix() leaves out the text
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return weighed.filter("copies > 0").withColumn("_copy", copies).withColumnRenamed("_body", of["text"]).select(*plain.columns).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in token sequences. Null and empty texts have only the end token; equal rows are packed each;
    very long texts are packed whole; an empty table gives an empty table."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has not the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with passing_steps() as steps:  # what the stage wrote on its way goes
            step = Written(stage(spark, docs, sf_dir))
            steps.remove(step)
        if before:
            before.drop()
        docs, before = step.df, step
    return docs
