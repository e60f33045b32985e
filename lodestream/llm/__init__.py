"""Operators for training-data pipelines. Nothing else in the package imports this."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
