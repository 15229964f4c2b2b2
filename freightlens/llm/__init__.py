"""Operators for building training data: each module is one operator.

Functions that run in Python tasks travel by value, so executors need numpy and
pyarrow but no copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
