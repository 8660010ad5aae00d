from __future__ import annotations

import pytest

from brindle.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("brindle-tests", master="local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
