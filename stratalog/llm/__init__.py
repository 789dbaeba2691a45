"""Operators of a training-data pipeline, each a Spark job over whole tables.

Python functions of this package travel to the executors by value, so a cluster
needs only the driver's copy of the code.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
