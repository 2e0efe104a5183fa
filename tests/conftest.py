from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from undertow.session import local_session

    folder = tmp_path_factory.mktemp("shared")
    session = local_session("4", name="tests", spark__checkpoint__dir=str(folder))
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Build a frame from tuples and a DDL schema."""

    def build(values, schema):
        return spark.createDataFrame(values, schema)

    return build
