import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from granary.session import session

    made = session("tests", cores=4, partitions=4, **{"spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared"))})
    yield made
    made.stop()
