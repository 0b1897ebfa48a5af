"""A Spark-native record-linkage engine."""

import sys

from pyspark import cloudpickle

# functions for executors travel whole, so that these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
