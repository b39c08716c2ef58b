import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from passarank.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    active = session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="passarank-tests-"),
        },
    )
    active.sparkContext.setLogLevel("ERROR")
    yield active
    active.stop()


def plan(df):
    """The physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()
