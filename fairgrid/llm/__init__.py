"""Operators for preparing training text. Nothing outside this package imports it.

Functions defined here travel to executors by value, so a job needs no copy of
the package on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
