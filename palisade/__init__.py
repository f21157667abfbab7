"""Palisade: security-log analytics on Spark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

from palisade.config import Settings
from palisade.session import get_session

# Functions that run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings", "get_session"]
