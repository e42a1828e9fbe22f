"""Audio-clip catalogs, signals, speakers and job streams as Spark tables.

Every public operator takes and returns DataFrames (or Columns); nothing is
collected apart from bounded, documented summaries.
"""

import sys

from pyspark import cloudpickle

# Functions and processors of the package travel to the executors by value, so a
# session started from any folder runs them without a path or an installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
