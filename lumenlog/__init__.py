"""A log-triage engine on Spark DataFrames.

Task-side functions are sent to executors by value, so a job needs no copy of the package on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
