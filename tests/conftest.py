import os

import pytest

from lodestream.session import local_session

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(__file__)))


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "tests", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def rows(df, *cols):
    """Rows as sorted tuples; nulls first."""
    out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(out, key=lambda t: tuple((x is not None, x if x is not None else 0) for x in t))
