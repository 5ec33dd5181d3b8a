"""Clause analytics as ordinary DataFrame-to-DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so these need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
