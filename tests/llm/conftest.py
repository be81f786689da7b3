import pytest

TEXTS = [
    "Plain words of a text.",
    None,
    "",
    " \n ",
    "a  b   c",
    "l'été don't <|endoftext|> x<|endoftext|>y",
    "İ STRASSE ΟΔΟΣ é á ́b 漢字 😀 \x00 nul \x1c fs",
    "word " * 5000,
    "x" * 3000,
    "Plain words of a text.",
]


def rows():
    out = [(i * 3 % 31, t, "en", "s", 1) for i, t in enumerate(TEXTS)]
    return [*out, out[0], (None, "a null key", None, None, None), (99, "a null key", None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empties, long and odd texts, repeated rows, clashing extra columns."""
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows()], "doc_id long, text string, lang string, source string, n_chars long, part long, ids string, rank int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sf_dir(spark, docs, tmp_path_factory):
    """A folder of tables with only these documents."""
    d = str(tmp_path_factory.mktemp("sf"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    return d
