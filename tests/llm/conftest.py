import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import hard  # noqa: E402

CLASH = ("lang string, source string, n_chars long, score double, domain string, key string, doc long, part long, n_words long, "
         "spans string, marks string, bucket int, guest boolean, packed binary, size int, piece string, label int")


@pytest.fixture(scope="session")
def rows():
    return hard.texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The awkward rows with extra columns of clashing names, all null."""
    extra = [None] * len(CLASH.split(","))
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], f"doc_id long, text string, {CLASH}").cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("doc_id is null")
