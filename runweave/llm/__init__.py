"""Operators for training-data pipelines over text. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Executors get the functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
