import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lodestat.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Turn {column: values} into a DataFrame."""
    import pandas as pd

    def make(columns, parts=None):
        df = spark.createDataFrame(pd.DataFrame(columns))
        return df.repartition(parts) if parts else df

    return make
