"""Folders with the small tables."""

from __future__ import annotations

import pytest

from tests.llm import tables


@pytest.fixture(scope="session")
def records():
    return tables.rows()


@pytest.fixture(scope="session")
def folder(tmp_path_factory, records):
    return tables.write(tmp_path_factory.mktemp("small") / "sf", records)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    return tables.write(tmp_path_factory.mktemp("empty") / "sf", [])
