"""Training-data operators.  Nothing else in the library imports this subpackage.

Functions sent to Python workers are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
