import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("QUERN_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from quern.session import session

    s = session("local[4]", 4)
    yield s
    s.stop()
