"""Nutrition and shelf-price analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions that run on executors travel with their job, so that
# executors need numpy and pandas but no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
