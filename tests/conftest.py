import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from leadloom.session import build_session

    session = build_session(
        "tests", master="local[8]", shuffle_partitions=8,
        spark__ui__enabled="false", spark__driver__memory="8g",
        spark__sql__streaming__stateStore__providerClass=(
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
