import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from opinio.session import get_session
    s = get_session("local[4]", 8, app_name="opinio-tests")
    # Tests only: when no shared folder is configured, a private one is used.
    from opinio.session import checkpoint_root
    checkpoint_root(s)
    yield s
    from opinio.session import clean_work_dirs
    clean_work_dirs(s)


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
