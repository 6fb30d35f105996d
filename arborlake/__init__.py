"""Raster and tree-crown analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions sent to Python workers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
