import os
import tempfile

import pytest

from larkspur.session import build_session


@pytest.fixture(scope="session")
def spark():
    checkpoints = os.environ.get("TEST_CHECKPOINTS") or tempfile.mkdtemp(prefix="spark-")
    session = build_session(4, "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{checkpoints}")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
