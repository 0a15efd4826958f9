import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4")


@pytest.fixture(scope="session")
def make_files(spark):
    def make(*contents, project="p"):
        rows = [(project, f"{project}/f{n}.php", c) for n, c in enumerate(contents)]
        return spark.createDataFrame(rows, "project STRING, path STRING, content STRING")

    return make


SF_DIR = "/root/testdata/sf0.001"
