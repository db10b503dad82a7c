import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabspark.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines_file(tmp_path_factory):
    """Writes lines to a file and gives its path."""

    def write(text, encoding="utf-8"):
        path = tmp_path_factory.mktemp("text") / "data.csv"
        path.write_bytes(text.encode(encoding))
        return str(path)

    return write
