import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelyard.plans import release  # noqa: E402
from panelyard.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    release(session)


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return SF
