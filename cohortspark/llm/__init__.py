"""Operators for preparing language-model training text.

Nothing else in the library imports this subpackage.  Functions that run in
Spark's Python workers are shipped by value, so the workers need numpy,
pyarrow and the tokenizer libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
