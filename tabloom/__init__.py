"""Tabular profiling, feature, drift and modelling operators for PySpark DataFrames."""

import sys

from pyspark import cloudpickle

from tabloom.session import spark_session

# functions that run in tasks travel with the job: executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["spark_session"]
__version__ = "0.1.0"
