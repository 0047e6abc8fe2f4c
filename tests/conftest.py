import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
# a plaintext demo ledger (the FIXTURES.md §3 goldens); golden tests skip when unset
EXAMPLE_LEDGER = os.environ.get("DEMO_LEDGER", "")


@pytest.fixture(scope="session")
def spark():
    from tallyframe.session import get_spark

    s = get_spark("local[4]", app_name="tallyframe-tests", shuffle_partitions=4)
    yield s
    s.stop()
