import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    import os

    from pyspark.sql import SparkSession

    root = str(Path(__file__).resolve().parent.parent)
    # workers import the package, and readers that tests define
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, f"{root}/tests", os.environ.get("PYTHONPATH")]))
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
