import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from turnloom.plans.fixtures import Tables

    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate column expressions on one row of named values."""

    def evaluate(expression, schema="x string", *values):
        df = spark.createDataFrame([tuple(values)], schema)
        return df.select(expression.alias("out")).collect()[0]["out"]

    return evaluate
