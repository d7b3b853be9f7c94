"""gridspark: grids, particles, matrices and experiment tables as Spark DataFrame programs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that only the
# driver needs it on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
