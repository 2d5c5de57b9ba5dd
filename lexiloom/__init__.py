"""Corpus preparation on Spark: every operator is a function from DataFrame to DataFrame."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so that executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
