"""Typing-log and free-text analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
