"""Batch semantic recommendation over DataFrames.

Records come out of landed pages, texts become passages, passages become vectors, and many
requests at once are answered by nearest-passage search, thresholded reciprocal-rank fusion
and a second-stage rerank.
"""

import sys

from pyspark import cloudpickle

# Ship the functions that run inside tasks by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
