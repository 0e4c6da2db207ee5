import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomwork.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoint"))
    session = local_session(4, partitions=4, **{"spark.checkpoint.dir": folder})
    yield session
    session.stop()


def rows(df):
    """Rows as a sorted list of tuples."""
    return sorted(
        (tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, str(v)) for v in t)
    )
