import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberlog.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="emberlog-test-ckpt-")
    s = build_session(
        "local[4]",
        app_name="emberlog-tests",
        extra={"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": ckpt,
               "spark.default.parallelism": "4"},
    )
    yield s
    s.stop()


@pytest.fixture()
def tmp_root():
    return tempfile.mkdtemp(prefix="emberlog-store-")
