"""Document search and source checking as batch and streaming Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
