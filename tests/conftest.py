import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from keystrata.session import local_session

    session = local_session(4, 4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """Builds a log from (key, epoch, seq, data); data None is a tombstone."""
    from keystrata.schema import LOG

    def build(*rows):
        return spark.createDataFrame([(k, e, s, int(d is None), d, None) for k, e, s, d in rows], LOG)

    return build


@pytest.fixture
def store(spark, tmp_path):
    from keystrata.plans.store import Store

    with Store.open(spark, str(tmp_path / "store")) as opened:
        yield opened


def rows(df):
    return [tuple(r) for r in df.collect()]
