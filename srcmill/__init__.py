"""Source-corpus analytics as Spark jobs.  Every public function takes and returns DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers get the helpers of this package with the task, so nothing has to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
