"""Variant-evidence analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so a cluster needs no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
