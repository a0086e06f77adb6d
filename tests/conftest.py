from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallyframe.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def export_files(spark):
    """{name: text or bytes} -> files DataFrame whose export_id is the name."""
    def build(files: dict[str, str | bytes]):
        rows = [("t", name, name, bytearray(v if isinstance(v, bytes) else v.encode())) for name, v in files.items()]
        return spark.createDataFrame(rows, "tenant_id string, export_id string, path string, content binary").select(
            "*", F.length("content").alias("length"))
    return build
