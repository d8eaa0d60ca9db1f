"""Operators for preparing training data: search, extraction, formatting,
decontamination, de-duplication, filtering, tokenising and placement.

Nothing outside this folder, ``corpus_pipeline.py`` and the guarded hook in
``__spark_entry__.py`` imports it.
"""

import sys

from pyspark import cloudpickle

# Executors get the functions used in tasks by value, so a cluster needs no
# copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
