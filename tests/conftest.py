import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("foliant-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Value of one column expression over a one-row table of constants."""

    def run(expression, **values):
        from pyspark.sql import functions as F

        row = spark.range(1)
        for name, (value, kind) in values.items():
            col = F.lit(None) if value is None else F.from_json(F.lit(value), kind) if (
                kind.startswith(("array", "struct"))
            ) else F.lit(value)
            row = row.withColumn(name, col.cast(kind) if value is None else col)
        return row.select(expression.alias("out")).first()["out"]

    return run
