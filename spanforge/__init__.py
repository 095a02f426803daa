"""Build and score sequence-summarization data with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Grouped steps are shipped by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
