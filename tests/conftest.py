"""One small local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pelagia.session import local_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session(cores=4, partitions=4, memory="4g"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
