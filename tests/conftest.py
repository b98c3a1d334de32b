import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

START = datetime(2026, 3, 8, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("logfathom-tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_events(spark):
    """Events from (seconds, level, message[, source]) tuples, arriving in list order."""
    def build(rows, source="app"):
        data = [(r[3] if len(r) > 3 else source, i,
                 (START + timedelta(seconds=r[0])).replace(tzinfo=timezone.utc), r[1], r[2])
                for i, r in enumerate(rows)]
        return spark.createDataFrame(
            data, "source string, seq bigint, ts timestamp, level string, message string")
    return build


@pytest.fixture
def make_raw(spark):
    def build(lines, source="app.log"):
        return spark.createDataFrame([(source, line, i) for i, line in enumerate(lines)],
                                     "source string, line string, seq bigint")
    return build
