from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def no_broadcast(spark):
    """No table is small enough to be broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield lambda: spark.conf.set(name, before)
    spark.conf.set(name, before)


@pytest.fixture(scope="session")
def corpus(spark):
    """Labelled texts: one class holds a third of the rows and many of its texts are copies."""
    rows = []
    for i in range(600):
        label = "big" if i % 3 == 0 else f"c{i % 7}"
        text = "the same text again" if i % 6 == 0 else f"text number {i} about topic{i % 11} and w{i * 7 % 13}"
        rows.append((i, text, label))
    return spark.createDataFrame(rows, "id bigint, text string, label string").repartition(5)
