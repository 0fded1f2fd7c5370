"""Listing price intelligence as Spark DataFrame jobs.

The package takes tables (or landed streams) of priced listings and turns them
into cleaned, de-duplicated, valued and scored rows.  Every operator is a
function from DataFrames to a DataFrame; tables of keywords, thresholds and
prices are parameters with defaults in :mod:`pricelode.config`.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so workers need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
