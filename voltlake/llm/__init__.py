"""Training-data operators: one module per operator, queries in ``queries``.

The worker-side functions are shipped by value, so executors need the third
party libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
