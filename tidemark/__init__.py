"""Tidemark: event-evidence analytics on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to Python workers by value: executors need no copy of it.
register_pickle_by_value(sys.modules[__name__])
