import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from arborlake.testing import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(partitions=4)
