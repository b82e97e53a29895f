"""Registered queries, the SQL they are checked against, and their inputs."""

import sys

from pyspark import cloudpickle

# as for the package itself: model functions defined here travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])
