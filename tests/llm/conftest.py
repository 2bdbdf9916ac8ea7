import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _text string, score string, id string"
SYLLABLES = {"en": "the ing tion er and ou th".split(), "de": "sch ung ein keit ich ber".split()}


def prose(lang: str, words: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(words)) + "."


def make_rows() -> list[tuple]:
    """Ordinary texts, copies, near copies, null and empty texts, a very long one, repeated rows, null columns."""
    texts = [prose("en" if i % 3 else "de", 30 + i, i) for i in range(40)]
    rows = [(i, t, "en" if i % 3 else "de", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[0], "de", None) for i in range(25)]
    rows += [(200, texts[1] + " extra", "en", "s1"), (201, None, "en", "s1"), (202, "", None, None), (203, " \n\t ", "en", "s2"), (204, "12 34 !!", "en", "s2"), (205, prose("en", 9000, 77), "en", "s0")]
    rows += [(5, texts[5], "en", "s1"), (None, texts[7], "en", "s3"), (None, "only here and nowhere", "en", "s3"), (206, "The THE café 日本語", None, "sé")]
    return [(i, t, la, so, None if t is None else len(t), "x", "y", "z", "w") for i, t, la, so in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """With columns that have the names of operators' own."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
