import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from compare import connect  # noqa: E402
from tablehaul.session import build_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tablehaul-tests", "8", 8)
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def db():
    return connect(DATA)
