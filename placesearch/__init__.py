"""Place directories and the search traffic around them, as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run inside tasks travel with the plan, so executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
