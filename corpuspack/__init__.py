"""corpuspack: language-model corpus preparation as Spark DataFrame jobs."""

import sys as _sys

__version__ = "0.1.0"

# Python code that runs inside tasks (the JSON tokenizer UDF, the .bin data source and
# writer) is shipped by value with the task, so executors need no install of this package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - an older cloudpickle: the package must be installed
    pass
