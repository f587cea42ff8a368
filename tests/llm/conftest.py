import sys

import pytest

sys.path.insert(0, "/root/repo")

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
