"""Detection and annotation analytics on Spark.

Functions of this package travel to executors by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
