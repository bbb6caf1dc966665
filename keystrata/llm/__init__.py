"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

import keystrata
from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that a cluster needs no copy of it on each machine.
cloudpickle.register_pickle_by_value(keystrata)
