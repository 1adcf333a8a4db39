"""gristmill: text-corpus analytics and retrieval on PySpark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors get the functions themselves, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
