"""revlens: corpus review analytics on Spark.

Every stage is a DataFrame -> DataFrame transform keyed by ``project``:
corpus scan and statistics, ordered budget packing into review chunks,
parsing of model replies into findings, dedup / rank / status, retry and
resume planning over attempt logs, model catalogs, secret hygiene, and
Structured Streaming versions of the running parts.
"""

import sys as _sys

try:  # ship our Arrow batch functions to Python workers by value, so the
    # package need not be installed on executors.
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__version__ = "0.1.0"
