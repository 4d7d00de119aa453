"""Training-data operators: language ID, LM scoring, de-duplication, packing,
chat formatting, BPE, quality, similarity join and nearest neighbours.

Self-contained: nothing else in the library imports this subpackage.
Functions that run inside Python workers are pickled by value, so executors
need no installed copy of the library.
"""

import importlib

from pyspark import cloudpickle

_MODULES = ("common", "pieces", "exactdedup", "langid", "quality", "packing", "bpe", "chat", "linededup", "ann", "lm", "jaccard", "hardneg", "divergence", "toxicity")

for _m in _MODULES:
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_m}"))
