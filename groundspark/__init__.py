"""Evidence retrieval and grounding as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the few Python helpers that run inside tasks by value, so that executors
# need no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
