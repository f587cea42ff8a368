import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from planwise.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    extra = {}
    from pyspark.sql import SparkSession
    active = SparkSession.getActiveSession()
    if active is None:
        # Tests bring their own shared folder only where none is configured.
        probe = build_session("local[4]", shuffle_partitions=8)
        if not (probe.conf.get("spark.checkpoint.dir", None) or probe.sparkContext.getCheckpointDir()):
            probe.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="planwise-test-"))
        return probe
    return build_session("local[4]", shuffle_partitions=8, extra=extra)


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="planwise-run-")
