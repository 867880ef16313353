"""Preparing, encoding, synthesising and judging categorical population tables on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks carry their code along, so that executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
