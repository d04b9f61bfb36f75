"""Terminology, fee-schedule and text analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python stages are shipped by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
