"""Operators for training-data pipelines over ``documents``; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry this package's code with them, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
