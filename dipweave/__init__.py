"""dipweave: finding and characterising transient dips in large collections of time series, on Spark."""

import sys

from pyspark import cloudpickle

# Functions go to the workers with their code, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
