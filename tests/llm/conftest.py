import pytest

from lapwing.llm import secret_scan


@pytest.fixture(scope="session")
def forest(spark):
    return secret_scan.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
