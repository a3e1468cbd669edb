"""Spark-native analytics over prompt, trace and training-data tables.

Functions that run in Python workers are pickled by value, so executors need
the third-party libraries only and not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
