"""Code-corpus analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry the code of this package with them, so
# executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
