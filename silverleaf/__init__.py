"""silverleaf: a PySpark-native analytics engine for large media libraries."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their own code, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
