import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tidings.session import build_session

    work = tempfile.mkdtemp(prefix="tidings-tests-")
    s = build_session(4, app="tidings-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": work, "spark.driver.memory": "4g"})
    yield s
    s.stop()


@pytest.fixture()
def headlines(spark):
    def make(rows, cols=("doc_id", "Headline")):
        return spark.createDataFrame(rows, list(cols))
    return make
