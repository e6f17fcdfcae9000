"""Shared session and small helpers."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quire.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", memory="6g", app="quire-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def texts(spark):
    """One-column frame of texts in a fixed order, and a reader for one result column."""

    def make(*values: str):
        return spark.createDataFrame(list(enumerate(values)), "id int, text string")

    return make


def column(df, name: str = "text", order: str = "id") -> list:
    return [r[name] for r in df.orderBy(order).collect()]
