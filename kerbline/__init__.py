"""Spark jobs that generate, evaluate and prepare vision-language navigation data.

Functions of this package travel to the executors by value, so a session started from any
folder can run them and nothing has to be installed on the workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
