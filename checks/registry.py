"""All registered queries, the quick ones first."""

# isort: skip_file
from checks import reports  # noqa: F401
from checks import tables  # noqa: F401
from checks import cubes  # noqa: F401
from checks import features  # noqa: F401
from checks import quality  # noqa: F401
from checks import series  # noqa: F401
from checks import sources  # noqa: F401
from checks import learning  # noqa: F401
from checks.base import QUERIES, SQL  # noqa: F401
