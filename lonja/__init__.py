"""lonja: a PySpark-native engine for sales lakehouse analytics and large data preparation."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel by value: the executors needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
