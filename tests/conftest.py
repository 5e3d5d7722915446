import os
import sys
from pathlib import Path

import pytest

# Small matrices: the threads of BLAS only get in each other's way.
os.environ["OMP_NUM_THREADS"] = os.environ["OPENBLAS_NUM_THREADS"] = "1"
ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from skerry.session import local_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return prepare(local_session(4, "4g", 4))
