"""Operators of a training-data pipeline. Nothing outside this package imports it.

Task functions travel to the executors by value, so these need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
