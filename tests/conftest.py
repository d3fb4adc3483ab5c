from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import SparkSession


#: The Python workers import the package too.
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).parents[1]), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
