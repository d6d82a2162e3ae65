import pytest
from pyspark.sql import functions as F

#: Names that the operators use inside; tables may have columns that bear them.
CLASHES = ["ident", "sig", "n", "score", "token_ids", "decoded", "label", "size", "copies", "up", "part", "number", "Text_", "start", "host", "removed", "id", "vector", "component"]


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeated rows and clashing columns."""
    long = "Ça va? der die das token 12 " * 12_000
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, long, "fr", "b"), (5, "one two three four five six seven eight", "en", "a"), (5, "one two three four five six seven eight", "en", "a"),
        (None, "one two three four five six seven eight", "de", "a"), (6, "ONE two three\tfour five six seven eight", "de", "c"), (7, "zwei", "de", None), (8, "<|endoftext|> 　 ‰ 😀 é é", None, "c"), (9, "0123 --- ...", "es", "c"), (10, None, None, None),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(messy):
    return messy.where("false")
