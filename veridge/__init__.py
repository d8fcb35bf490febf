"""veridge: graph analytics and table operators expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that it needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
