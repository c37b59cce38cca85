import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codeloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, app="codeloom-tests")


@pytest.fixture(scope="session")
def corpus(spark):
    """``corpus({path: text, ...})`` or ``corpus([(repo, path, text), ...])``."""
    from codeloom.sources.corpus import from_text

    def make(files):
        rows = [(1, p, t) for p, t in files.items()] if isinstance(files, dict) else files
        return from_text(spark.createDataFrame(rows, "repo_id long, path string, content string"))

    return make
