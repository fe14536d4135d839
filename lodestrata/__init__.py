"""Lodestrata: retrieval, evidence and training-data analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package go to Python workers as they are, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
