"""graphloom: knowledge-graph analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel inside the task, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
