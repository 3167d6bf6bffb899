"""Operators that prepare text for training language models (one module each)."""

import staylens
from pyspark import cloudpickle

# Functions travel to the executors by value, which need no copy of the package.
cloudpickle.register_pickle_by_value(staylens)
