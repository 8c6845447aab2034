import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(n: int) -> dt.date:
    """Day ``n`` of January 2020, running on into the following months."""
    return dt.date(2019, 12, 31) + dt.timedelta(days=n)


def rows(df, *columns):
    """Sorted tuples of the named columns, or of all."""
    found = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in found.collect()), key=lambda r: [(v is not None, str(v)) for v in r])
