import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from quern.session import session

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = session("tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="4g", spark_ui_enabled="false", spark_sql_warehouse_dir=f"{folder}/warehouse", spark_checkpoint_dir=f"{folder}/shared")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
