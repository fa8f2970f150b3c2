"""Operators that prepare training text: cleaning, deduplication, formatting, packing."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that these need not have it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
