from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from compscope.session import local_session

    session = local_session("*", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def con():
    from oracle_check import connect

    return connect(SF)
