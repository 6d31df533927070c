import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from postmill.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
           "spark.checkpoint.dir": str(shared / "staged"), "spark.sql.warehouse.dir": str(shared / "warehouse"),
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
           # tiny inputs: one task per step keeps the suite quick
           "spark.default.parallelism": "2"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
