import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from checks.compare import session
    from pyspark import cloudpickle

    import scanloom
    cloudpickle.register_pickle_by_value(scanloom)
    s = session("8", "8")
    yield s
    s.stop()


@pytest.fixture
def project(spark):
    """A table of files from a dict of path to text."""

    def make(files, project_id="p"):
        rows = [(project_id, path, content) for path, content in files.items()]
        return spark.createDataFrame(rows, "project_id string, path string, content string")

    return make
