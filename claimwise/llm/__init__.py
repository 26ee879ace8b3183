"""Training-data operators on Spark: near-duplicate detection, decontamination,
pseudonyms, page extraction, vector search, line dedup, tokenisation, quality
scoring, web archives and token counts.

Nothing outside this subpackage imports it (``__spark_entry__`` and
``corpus_pipeline`` register its queries). Functions that run in Python workers
are shipped by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
