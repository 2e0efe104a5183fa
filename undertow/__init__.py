"""Audit one flat table with Spark: repair it, profile it, and list what plain averages hide."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from undertow.plans.audit import Audit, audit  # noqa: E402
from undertow.plans.investigate import investigate  # noqa: E402
from undertow.sources.readers import read_table  # noqa: E402

__all__ = ["Audit", "audit", "investigate", "read_table"]
