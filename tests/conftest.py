import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from quakespark.session import build_session

    SparkSession.builder.config("spark.ui.enabled", "false")

    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
