import pathlib
import sys

sys.path[:0] = [str(pathlib.Path(__file__).parent.parent), str(pathlib.Path(__file__).parent)]

import pytest  # noqa: E402
from feed_rows import GOOD  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def feed_of(spark):
    """Build a feed from dicts that name only what differs from a flawless product."""
    from shelfgauge.schema import FEED_SCHEMA

    def build(*products):
        rows = [tuple({**GOOD, **product}.values()) for product in products]
        return spark.createDataFrame(rows, FEED_SCHEMA)

    return build
