"""gleaner: retrieval analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from gleaner.session import local_session, shared_dir

__all__ = ["local_session", "shared_dir"]

# The few functions that run in Python workers travel with their task, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
