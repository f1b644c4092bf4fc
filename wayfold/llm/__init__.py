"""Operators for training-data pipelines (nothing else in the library imports this).

Functions of this package that run inside tasks are sent by value with the plan, so executors need
its libraries (numpy, pyarrow, ...) but no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
