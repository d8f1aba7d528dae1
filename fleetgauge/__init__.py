"""Measurement and evidence operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with the job, so workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
