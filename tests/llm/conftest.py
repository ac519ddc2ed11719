import pytest
from pyspark.sql import Row
from tests_llm_helpers import passages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, fp string, bits string, row string, at string"


def awkward() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, repeated rows, ties, odd characters, and a very long text."""
    base = passages(1, 12, 60)
    long = " ".join(passages(2, 60, 400))
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, None), (21, None), (22, ""), (23, " \n\t "), (24, "\x0b"), (25, "1234 5678"), (26, "a"), (27, "a b"), (28, "A  B")]
    rows += [(30, base[0]), (31, base[0].replace(" ", "  ")), (32, base[1] + " extra"), (33, base[2].upper())]
    rows += [(40, "same row"), (40, "same row"), (40, "other text under one id"), (None, base[3]), (None, "alone"), (None, None)]
    rows += [(50, long), (51, "x" * 5000), (52, "x" * 5000), (53, long[:1000] + " cut " + long[1000:3000])]
    rows += [(60, "line one of the set here\nline two of the set here\n\nline one of the set here"), (61, "line one of a set here\nsomething else entirely new today")]
    rows += [(62, "naïve café — “quotes” 日本語 𝔘𝔫𝔦"), (63, "line one of the set here"), (64, "line two of the very set here")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The awkward rows with more columns, some of them named as the operators' own."""
    data = [Row(i, t, "en", "s", 0, "x", "y", "z", "w", "v", "u") for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
