"""Profiling, reconciliation, copying and table work as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
