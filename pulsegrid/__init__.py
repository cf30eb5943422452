"""Keyed time-series panel analytics on Spark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Python functions run by executors travel by value, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
