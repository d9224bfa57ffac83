import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from harrow.runtime import local_session  # noqa: E402
from harrow.sources.tables import Tables  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture
def one(spark):
    """Evaluate one expression."""

    def run(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return run
