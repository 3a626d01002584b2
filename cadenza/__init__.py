"""cadenza: event-pacing analytics and training-data operators on PySpark."""

import sys

from pyspark import cloudpickle

# What tasks need of this package travels with them, so that executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
