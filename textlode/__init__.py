"""Labelled-text and embedding analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package that run on executors travel by value, so that workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
