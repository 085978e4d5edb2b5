import pytest

LONG = "word " * 40_000 + "x" * 20_000
#: Names that the operators use inside, as extra columns of the input.
CLASHES = "id node key keys x g h n own row_ text_ words plain text_hash cells root n_words upper piece cell count score label l positive".split()


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "a"),
        (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "a"),
        (2, None, "en", "a"),
        (3, "", None, None),
        (None, "Some text with words in it and no id of its own at all.", None, "b"),
        (None, None, None, None),
        (4, LONG, "en", "a"),
        (5, " \n\t ", "de", "b"),
        (6, "Ünïcödé 𝔘𝔫𝔦 wörter\nzwei\nzwei", "de", "b"),
    ]
    return with_clashes(spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"<{c}>").alias(c) for c in CLASHES if c not in df.columns))
