import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from treelight.session import local_session, ship

    session = local_session(4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    ship(session)
    yield session
    session.stop()


def tree(spark, rows):
    """Entries from (slot, frn, parent, name, is_dir), with the root C:."""
    from treelight.operators.paths import as_entries

    rows = [("C", 0, 5, None, "C:", True)] + [("C", *r) for r in rows]
    return as_entries(spark.createDataFrame(rows, "drive string, slot long, frn long, parent_frn long, name string, is_dir boolean"))


@pytest.fixture
def make_tree(spark):
    return lambda rows: tree(spark, rows)
