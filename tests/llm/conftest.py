import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that the operators use for their own results or on the way to them.
CLASHING = ("n_tokens string, ids_sha256 string, score string, predicted string, lang_pred string, fingerprint string, "
            "component_id string, file string, row string, key string, n string, size string, target string, digest "
            "string, kept string, copies string, start string, end string, fp string, root string, spans string, "
            "share string, term string, level string, bits string, part string, kind string, half string, toxic string")
LONG = "lorem ipsum dolor sit amet consectetur " * 6000


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, ties, repeated rows, one very long text."""
    return [
        (1, "Hello World again", "en", "b", 17), (2, "hello world AGAIN", "en", "a", 17),
        (2, "hello world AGAIN", "en", "a", 17), (None, "hello world again", None, None, None),
        (None, None, None, None, None), (3, None, "en", "a", None), (4, "", "fr", None, 0), (5, " \t\n", "de", "b", 3),
        (6, LONG, "en", "c", len(LONG)), (7, "ÉTÉ été ça", "fr", "c", 10), (8, "été ÉTÉ ça", "fr", "c", 10),
        (9, "x", "en", "a", 1), (10, "!!! 123 ???", None, "b", 11), (11, LONG[:-5], "en", "d", len(LONG) - 5),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, odd_rows):
    """The odd rows with many more columns, some null."""
    n = len(CLASHING.split(", "))
    rows = [(*r, *["other" if i % 2 else None] * n) for i, r in enumerate(odd_rows)]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}")


@pytest.fixture(scope="session")
def empty_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def read(spark, path, name="documents"):
    return spark.read.parquet(f"{path}/{name}.parquet")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
