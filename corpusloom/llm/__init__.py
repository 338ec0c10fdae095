"""Operators for preparing training corpora of language models.

Nothing outside this folder imports it.  The functions that run inside tasks are sent to the
workers by value, so that executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
