"""Anonymization of large tables of personal records on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the plan, so that executors need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .plans.anonymize import (  # noqa: E402
    METHODS,
    Method,
    anonymize,
    anonymize_mondrian,
    assign_classes,
    bucket_plan,
    class_plan,
    threshold_sweep,
)
from .roles import Roles  # noqa: E402

__all__ = [
    "METHODS",
    "Method",
    "Roles",
    "anonymize",
    "anonymize_mondrian",
    "assign_classes",
    "bucket_plan",
    "class_plan",
    "threshold_sweep",
]
