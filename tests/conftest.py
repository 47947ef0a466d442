import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
# Python workers find the package too, wherever pytest was started
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (os.environ.get("PYTHONPATH"), ROOT) if p)


@pytest.fixture(scope="session")
def spark():
    from turnlake.session import local_session

    s = local_session("*", shuffle_partitions=8, app="turnlake-tests")
    yield s
    s.stop()
