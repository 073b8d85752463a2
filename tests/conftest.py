import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from newsloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
