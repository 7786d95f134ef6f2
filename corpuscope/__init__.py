"""Text and code corpus analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python functions that run in tasks travel with their job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
