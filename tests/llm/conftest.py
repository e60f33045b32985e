import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"

WORDS = " ".join(f"w{i}" for i in range(60))
#: Nulls, empty, white space, repeats, ties, long runs, other scripts.
ODD = [
    (-1, None),
    (-2, ""),
    (-3, " \n\t "),
    (-4, WORDS),
    (-5, "pre " + WORDS + " post"),
    (-6, WORDS),
    (-7, "a b c d"),
    (-8, "a b c d"),
    (-9, "a b c d e"),
    (-10, "x " * 400),
    (-11, "x " * 300),
    (-12, "日本語のテキスト 中国的文字 ñandú é 😀"),
    (-13, "1" * 3000),
    (-14, "a." * 1500 + "@b.c"),
    (-15, "line one is here now\nline one is here now\n\nline two"),
    (-16, "l" * 5000),
    (-17, "One\x0btwo\x1fthree\x85four　five"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents with odd rows, an extra column and one with a clashing name."""
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], DOCS)
    return spark.read.parquet(f"{DATA}/documents.parquet").unionByName(odd).selectExpr("*", "'x' as base", "1 as ids").cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
