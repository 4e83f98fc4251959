"""A PySpark-native engine for weekly cross-sectional panel analytics."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with their code, which therefore need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
