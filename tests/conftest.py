from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sourceloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def analysed(spark):
    """Analyse (path, content) pairs and return one dict per path."""
    from sourceloom.operators import kb

    def run(*files):
        rows = [(i, "r", path, content) for i, (path, content) in enumerate(files)]
        df = spark.createDataFrame(rows, "file_id long, repo string, path string, content string")
        return {r["path"]: r.asDict(recursive=True) for r in kb.build(df).collect()}

    return run
