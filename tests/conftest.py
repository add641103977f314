import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logtable.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("staging")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    configure(session)
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Rows of strings with line numbers, spread over several partitions."""

    def make(columns, rows):
        numbered = [(*row, i + 1) for i, row in enumerate(rows)]
        schema = ", ".join(f"`{c}` string" for c in columns) + ", line_no bigint"
        return spark.createDataFrame(numbered, schema).repartition(3)

    return make
