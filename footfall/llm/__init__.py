"""Operators over training text. Nothing else in the library imports this subpackage.

Its functions travel to the executors by value, so these need the libraries it uses but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
