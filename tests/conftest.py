from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parent.parent)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:  # noqa: ANN001
    tmp = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").config("spark.checkpoint.dir", str(tmp / "shared"))
        .config("spark.local.dir", str(tmp / "local")).config("spark.sql.warehouse.dir", str(tmp / "warehouse")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf() -> str:
    return "/root/testdata/sf0.001"
