"""Cohort early-warning analytics on Spark.

Importing the package starts nothing: no session, no read, no fit.
"""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the task, so executors
# do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
