import os

import pytest

from eventskim.plans.fixtures import VIEWS, view
from eventskim.session import build_session
from eventskim.sources import write_group

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        spark__master="local[4]",
        spark__driver__memory="4g",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__sql__maxMetadataStringLength="10000",
        spark__sql__debug__maxToStringFields="1000",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def root(spark, sf_dir, tmp_path_factory):
    """All groups stored as files, so that plans start from plain columns."""
    root = str(tmp_path_factory.mktemp("groups"))
    for group in VIEWS:
        write_group(view(spark, sf_dir, group, stamped="CA15" in group), root, group)
    return root
