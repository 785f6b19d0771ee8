"""Operators for preparing training data at scale.  Nothing outside this subpackage imports it."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions that run on executors travel by value, so that executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
