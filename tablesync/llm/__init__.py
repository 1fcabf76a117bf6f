"""Operators of a training-data pipeline; nothing else in the library imports them.

Their batch functions travel to the executors by value, so executors need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
