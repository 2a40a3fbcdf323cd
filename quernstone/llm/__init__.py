"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage, so it can be removed as a
folder. Functions that run in Python workers are pickled by value: a worker
then needs no path to this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
