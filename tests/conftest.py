import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session("tests", spark_master="local[4]", spark_driver_memory="4g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_sql_shuffle_partitions="4", spark_checkpoint_dir=f"file://{shared}")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
