"""Queries over the driver's tables and the SQL they are compared with."""

import sys
from importlib import import_module

from pyspark import cloudpickle

# code that runs in tasks travels with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = ("panels", "cleaning", "scaling", "encoding", "aggregates", "drifting", "statistics", "splitting", "sourcing", "neighbouring", "modelling", "composing", "invariants",
           "planted")


def load() -> None:
    for name in MODULES:
        import_module(f"checks.{name}")
