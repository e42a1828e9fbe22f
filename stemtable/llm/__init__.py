"""Operators for preparing training data: language, duplicates, quality, leaks,
URLs, page text, source mixes and licenses.

Functions of this package travel to the executors by value, so that nothing
has to be installed or put on a path there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
