"""corpusloom: document preparation, retrieval, evaluation and run-log jobs on Spark.

Every operator takes and returns DataFrames or Columns.  Nothing here starts a
session; callers bring their own.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel with the job, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
