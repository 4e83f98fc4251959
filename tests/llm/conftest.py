import pytest

#: Rows that every operator over documents must take: nulls, empty and blank texts, repeats, ties, a long text, personal data.
LONG = " ".join(f"word{k % 977} and{k % 13}" for k in range(6000))
PASSAGE = " ".join(f"shared{k}" for k in range(60))
ROWS = [
    (1, "alpha beta gamma " * 30, "en", "src1"), (2, "alpha beta gamma " * 30, "en", "src1"), (2, "alpha beta gamma " * 30, "en", "src1"), (3, None, "en", "src2"),
    (4, "", None, "src2"), (5, " \t\n ", "de", None), (6, LONG, "en", "src0"), (7, LONG + " tail", "en", "src0"), (8, "Mail a.b@c.org, card 4111 1111 1111 1111 or +1 (234) 555-0199 at 10.0.0.1!", "fr", "src5"),
    (9, f"one two {PASSAGE} three", "es", "src7"), (10, f"four {PASSAGE} five six", "es", "src7"), (11, "été ß ÉTÉ 日本語 don't", None, None), (12, "a b", "en", "src1"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Extra columns whose names operators use inside.
CLASHES = ("words", "key", "bucket", "fp", "marks", "score", "epoch", "domain", "digest", "last", "kept_id", "least", "length", "n_words", "place")


@pytest.fixture(scope="session")
def docs(spark):
    found = spark.createDataFrame(ROWS, SCHEMA).coalesce(2)
    for name in CLASHES:
        found = found.selectExpr("*", f"'x' AS {name}")
    return found


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def plain():
    return ROWS
