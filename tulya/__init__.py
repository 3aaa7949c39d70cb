"""Tulya: a PySpark-native engine that audits bilingual document corpora."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
