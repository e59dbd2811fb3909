"""Shared session; the checkpoint folder is taken from the session or made for local runs."""

from __future__ import annotations

import pytest

from tests.compare import spark_session


@pytest.fixture(scope="session")
def spark():
    session = spark_session()
    yield session
    session.stop()
