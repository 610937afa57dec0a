"""sparkseries: time-series analysis of Parquet tables as lazy Spark DataFrame plans."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Ship this package's Python code inside the pickled UDFs, so executors need
# not have it installed (or on their path) for the few pandas UDFs it uses.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from sparkseries.functions import block_agg, merged_agg, spark_agg
from sparkseries.operators import *  # noqa: F403
from sparkseries.operators import __all__ as _ops
from sparkseries.session import build_session, shared_dir
from sparkseries.sources import *  # noqa: F403
from sparkseries.sources import __all__ as _srcs

__all__ = ["block_agg", "build_session", "merged_agg", "shared_dir", "spark_agg", *_ops, *_srcs]
