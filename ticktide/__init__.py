"""ticktide: unit-aware, self-describing time-series analytics on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package reach the executors whole, so these need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
