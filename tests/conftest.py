import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
FIXTURES = os.path.join(ROOT, "tests", "fixtures")


@pytest.fixture(scope="session")
def spark():
    from streamwatch.session import get_session
    s = get_session("local[4]", app="streamwatch-tests", shuffle_partitions=8,
                    extra={"spark.ui.enabled": "false"})
    # Tests may set their own shared folder only when the session has none.
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sw-test-ckpt-"))
    yield s


def fixture_path(name: str) -> str:
    return os.path.join(FIXTURES, f"{name}.csv")
