"""Operators for preparing training data.

Task functions travel by value, so that executors need no installed package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
