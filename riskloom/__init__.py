"""riskloom: claims-risk analytics as Spark DataFrame operators.

Layout
------
sources/    readers and writers (fixture tables, claims view, sinks)
functions/  Column -> Column helpers (tiers, masking, numeric guards)
operators/  DataFrame -> DataFrame operators (clean, split, features, scoring,
            evaluation, drift, quality, compliance, graph, explain, ...)
plans/      the registered query catalogue built from the operators
streaming/  Structured Streaming twins of the batch operators
"""

__version__ = "0.1.0"
