"""PySpark-native analytics for operational metric logs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks are shipped by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
