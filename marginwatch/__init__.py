"""Revenue-leakage analytics as plain PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the tasks, so that workers need
# not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
