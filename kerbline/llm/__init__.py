"""Operators of a training-data pipeline; the rest of the library does not import them.

Functions of this subpackage that run in Python workers travel with the job, so
executors need Spark and the named libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
