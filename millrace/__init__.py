"""Tabular preparation, mining and model evaluation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels run inside Python workers; pickling this package by value means the
# executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
