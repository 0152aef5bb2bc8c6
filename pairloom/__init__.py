"""Phrase-pair similarity jobs on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel inside the tasks, so that workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
