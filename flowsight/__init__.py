"""Flowsight: network-flow analytics as plain DataFrame -> DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
