"""Spark-native retrieval analytics over document collections."""

import sys

from pyspark import cloudpickle

# The few Arrow kernels are plain functions of this package. Sending them by
# value spares executors an installation of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
