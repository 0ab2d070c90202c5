from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from corpuslab.session import local_session

    session = local_session(8, shuffle_partitions=4)
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("CORPUSLAB_SF_DIR", "/root/testdata/sf0.001")
