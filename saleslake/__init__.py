"""Sales analytics on Spark: bronze, silver and gold layers as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry the package's code with them, so that a cluster needs no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
