import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from foliospark.session import build_session

    session = build_session("tests", "local[8]", 4, tempfile.mkdtemp(prefix="tests-"))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
