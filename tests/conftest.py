import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from splitmill.session import local_session

    s = local_session("*", 8, app="splitmill-tests")
    yield s


def rows(df, *cols):
    """Collected rows as dicts (optionally only some columns)."""
    out = [r.asDict() for r in df.collect()]
    if cols:
        out = [{c: r[c] for c in cols} for r in out]
    return out
