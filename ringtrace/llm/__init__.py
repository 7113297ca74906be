"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.  Functions that run
inside Python tasks are pickled by value, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
