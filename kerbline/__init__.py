"""Transit telemetry analytics as DataFrame operators.

Functions that run in Python workers travel with the job, so executors need
Spark, numpy and pandas, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
