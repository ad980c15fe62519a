"""Language-model corpus preparation as Spark DataFrame and Structured Streaming jobs."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions with the job, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
