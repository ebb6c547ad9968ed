import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from marlspike.session import local_session

    session = local_session(4, "6g", "tests", spark__sql__shuffle__partitions="4", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    yield session
    session.stop()


@pytest.fixture()
def rows():
    """The rows of a table as sorted tuples, nulls first."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, x) for x in r])
