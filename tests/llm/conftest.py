import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__))]

from awkward_rows import AWKWARD  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows with a language, a source and extra columns named like the operators' own."""
    rows = [(i, t, ["en", "fr", None][k % 3], ["b", None, "a", "B"][k % 4], len(t or ""), k, "z", 1.0, k) for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, run long, cls string, score double, n long")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
