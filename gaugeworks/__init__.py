"""Conversation evaluation on Spark DataFrames.

Column helpers live in ``functions``, DataFrame transforms in ``operators``,
readers and writers in ``sources``, compositions in ``plans`` and the
append-only variants in ``streaming``.
"""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job, so that executors
# need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
