"""Tessera: point-in-time panel analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with their task, so executors
# need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
