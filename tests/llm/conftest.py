import pytest
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"

#: Null texts, empty texts, repeated rows, a null id, one long text, white space, letters of other scripts.
ODD = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, "The end of the day, and the end of it.", "en", "s", 38),
    (3, "The end of the day, and the end of it.", "en", "s", 38),
    (None, "Der Anfang der Woche und das Ende.", None, None, None),
    (5, " \t\n\x0b ", "de", "s", 5),
    (6, "naïve İstanbul ΑΣ 日本語 'S don't <|endoftext|> ½² ʼn", "fr", None, 48),
    (7, "lorem ipsum dolor " * 6000, "en", "s", 108000),
    (8, "12345 !!! ???", "en", "s", 13),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns named like those that operators add or work with."""
    names = ("score", "n_tokens", "n_bytes", "lang_pred", "kept", "fingerprint", "row_id", "word", "d", "id", "fp", "spans", "license", "path", "item_id", "_row")
    return odd.select("*", *(F.lit("x").alias(n) for n in names))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}
