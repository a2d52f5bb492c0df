"""splitmill: controlled-experiment analytics as Spark DataFrame transformations.

Layers (each a set of DataFrame -> DataFrame functions):

* ``sources``   – event / assignment / audience / corpus readers, sinks, metric catalog
* ``operators`` – exposure, unit aggregation, sufficient statistics, statistical tests,
                  planning, SRM, reporting, entity tables, quality checks, similarity
* ``functions`` – Column helpers (numpy-like division, distribution tails, text)
* ``plans``     – an observation run end to end, job wrapper, planner
"""

__version__ = "0.1.0"
