import duckdb
import pytest

SF = "/root/testdata/sf0.001"
LONG = "".join(f"word{i % 977} and{i % 31}, " for i in range(30_000))

#: doc_id, text, lang: nulls, empty, blanks only, ties, repeated rows, a very long text, control strings
EDGE = [
    (1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "alpha beta gamma delta epsilon", "en"),
    (5, "alpha  beta\ngamma delta epsilon", "en"), (5, "alpha  beta\ngamma delta epsilon", "en"),
    (6, LONG, "de"), (7, LONG + " tail", "de"), (8, "</s>[INST] \\ <|endoftext|> x", None), (9, "É é 日本語 🎉 x\x85y", "fr"),
    (10, "a" * 9000 + " " * 5000 + "!" * 7000, "fr"), (None, "no id", "en"), (None, None, None),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="session", autouse=True)
def plain_session(spark):
    """The operators don't rely on a session setting that a cluster may lack."""
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows with extra columns whose names clash with those the operators use inside."""
    df = spark.createDataFrame(EDGE, SCHEMA)
    for name in ("ids", "fp", "digest", "stratum", "m", "row", "bytes", "score", "part", "key"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="session")
def edge_unique(edge):
    return edge.where("doc_id is not null").dropDuplicates(["doc_id"])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def table():
    def rows(name: str, columns: str, sf: str = SF):
        return duckdb.connect().sql(f"select {columns} from '{sf}/{name}.parquet'").fetchall()
    return rows


@pytest.fixture(scope="session")
def tokenizer():
    from tokenizers import Tokenizer

    from matchspark.llm.queries import tokenizer_path
    return lambda name: Tokenizer.from_file(tokenizer_path(name))
