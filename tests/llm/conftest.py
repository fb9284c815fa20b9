import pytest

from corpus_samples import COLUMNS, ODD, long_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame([*ODD, (9, long_text(), "en", "t", 1, "x")], COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def few_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
