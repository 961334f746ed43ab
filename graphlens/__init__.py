"""Spark-first analytics over populations of networks.

Functions of this package travel to executors by value, so a cluster needs no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .config import CRITERIA, READOUTS, Protocol  # noqa: E402
from .functions.measures import MEASURES, NAMES, SELECTED, SIMILARITIES  # noqa: E402
from .operators.scoring import score  # noqa: E402
from .plans.experiments import Recovery  # noqa: E402
from .plans.protocol import Report, evaluate, published_readouts  # noqa: E402
from .plans.verify import errors, measure_table, nearer  # noqa: E402
from .sources.archives import read_archive, remembered  # noqa: E402
from .sources.readers import data_dir, home, read_geometry, read_nested, read_networks, read_optional, read_published, read_reference, read_stack, read_table, reference_dir  # noqa: E402

__version__ = "0.1.0"
__all__ = [
    "CRITERIA", "MEASURES", "NAMES", "READOUTS", "SELECTED", "SIMILARITIES", "Protocol", "Recovery", "Report", "data_dir", "errors", "evaluate", "home", "measure_table", "nearer", "published_readouts", "read_archive", "read_geometry", "read_nested",
    "read_networks", "read_optional", "read_published", "read_reference", "read_stack", "read_table", "reference_dir", "remembered", "score",
]
