"""Reliability analytics on Spark: DataFrame operators over prediction logs and labelled record tables."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to the executors by value, so that nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
