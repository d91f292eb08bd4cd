"""Spark jobs for building text-safety corpora and judging two-stage detectors."""

import sys

from pyspark import cloudpickle

# Python tasks carry the functions of this package with them; executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
