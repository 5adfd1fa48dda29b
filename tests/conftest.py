from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from loomgraph.session import local_session, release, ship_package

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("OFF")
    ship_package(session)
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def small_dir() -> str:
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data here")
    return path
