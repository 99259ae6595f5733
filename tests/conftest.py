import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from landgrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "landgrid-tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


def grid_frame(spark, rows, name="cls", kind="int", yr=2000):
    """A list of rows of values to a pixel table."""
    width = max(len(r) for r in rows)
    data = [(r * width + c, r, c, yr, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(data, f"cell_id bigint, r bigint, c bigint, yr int, {name} {kind}")


@pytest.fixture
def frame(spark):
    return lambda rows, **kw: grid_frame(spark, rows, **kw)
