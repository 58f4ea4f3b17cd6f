import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from riskweave.session import local_session

    session = local_session("tests", cores=8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def many_buckets(monkeypatch):
    """Sketch few rows per bucket, so that small data fills many buckets unevenly."""
    from riskweave.operators import ranking

    monkeypatch.setattr(ranking, "SKETCH_ROWS_PER_BUCKET", 20)
