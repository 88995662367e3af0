"""Operators for preparing training data: text, pages and archives, each a Spark job over whole tables."""

import sys

from pyspark import cloudpickle

# Workers may lack this package on their path: functions of it travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
