import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sheetloom import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    settings = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    session = build_session("local[8]", "tests", **settings)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def values(df, *columns):
    """Rows as tuples, in order."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
