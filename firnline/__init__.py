"""firnline: daily gridded melt analytics expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors with the job; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
