"""Spark-native retrieval, corpus hygiene and training-data engine.

Functions that run inside Python workers are pickled by value, so executors
need only the third-party packages, not a copy of this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
