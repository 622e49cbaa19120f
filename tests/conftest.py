import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logmill.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    session = builder.getOrCreate()
    if not session.sparkContext.getConf().get("spark.checkpoint.dir"):
        session.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="logmill-"))
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


@pytest.fixture
def docs(spark):
    def make(*texts):
        rows = [(i, f"d{i}.log", t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, name string, text string")

    return make
