import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from orderlens.session import build_session
    ckpt = tempfile.mkdtemp(prefix="orderlens-test-ckpt-")
    s = build_session("local[4]", shuffle_partitions=8, checkpoint_dir=ckpt,
                      extra={"spark.driver.memory": "4g"})
    yield s
    s.stop()
