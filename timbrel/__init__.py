"""timbrel: Spark-native operators for annotated speech and dialogue corpora.

Sub-packages: ``sources`` (corpus readers), ``functions`` (column helpers),
``operators`` (relational and signal operators), ``plans`` (named queries over
the test tables), ``streaming`` (incremental scoring) and, optional and used by
nothing else here, ``llm`` (training-data operators).
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that executors need
# not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
