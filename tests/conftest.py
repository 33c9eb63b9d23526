import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from foldloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("foldloom-tests", "local[4]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    folder = os.environ.get("FOLDLOOM_SF_DIR", "/root/testdata/sf0.001")
    if not Path(folder).exists():
        pytest.skip("test tables are not available")
    return folder
