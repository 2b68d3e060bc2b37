import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for p in (str(ROOT), str(ROOT / "tests")):
    if p not in sys.path:
        sys.path.insert(0, p)
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")])

DATA = Path(os.environ.get("QUILLSPAN_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from quillspan.session import build_session

    made = build_session(
        "tests", "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1m"},
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def tiny():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def hostile(tmp_path_factory):
    """The smallest tables with nulls in every column, repeated rows, odd texts, extra columns."""
    from fixtures import write_hostile

    return write_hostile(DATA / "sf0.001", tmp_path_factory.mktemp("hostile"))


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    """All tables without rows."""
    from fixtures import write_empty

    return write_empty(DATA / "sf0.001", tmp_path_factory.mktemp("empty"))
