"""Financial reconciliation and analytics as Spark DataFrame plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run on executors travel by value, so that executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
