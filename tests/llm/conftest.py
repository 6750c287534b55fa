import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rows():
    """Rows of a DataFrame as a list of dictionaries."""
    return lambda df: [r.asDict(recursive=True) for r in df.collect()]
