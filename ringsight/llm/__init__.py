"""Operators for preparing language-model training text. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions of this package are sent to the executors by value: these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
