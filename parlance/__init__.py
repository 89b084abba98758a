"""parlance — opinion-corpus analytics (tagging, features, clustering, reports) on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions of this package travel to the executors by value: a job works from any folder, without
# an installed copy or a PYTHONPATH on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
