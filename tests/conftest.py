import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from paceline.session import make_session

    folder = tmp_path_factory.mktemp("checkpoints")
    s = make_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{folder}",
           "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(folder / "warehouse")},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
