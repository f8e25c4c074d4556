"""A PySpark library for ordered event logs: state changes, near-duplicate events, step sequences and nested JSON."""

from pyspark import cloudpickle

# Python workers get functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(__import__(__name__))
