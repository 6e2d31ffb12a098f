import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import small  # noqa: E402


@pytest.fixture(scope="session")
def plain(spark, tmp_path_factory):
    """(rows, data frame from files) with distinct ids."""
    made = small.rows()
    return made, small.frame(spark, made, tmp_path_factory.mktemp("plain"))


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """(rows, data frame from files) with repeated rows and null ids."""
    made = small.odd_rows()
    return made, small.frame(spark, made, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    """An empty table from files."""
    return small.frame(spark, [], tmp_path_factory.mktemp("none"))
