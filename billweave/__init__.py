"""Document field extraction, reconciliation and reporting as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python workers get the archive reader with the task; nothing to install there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
