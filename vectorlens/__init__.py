"""Embedding-table analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Arrow kernels are pickled by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
