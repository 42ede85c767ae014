"""cartlens — purchase analytics expressed as Spark DataFrame operators.

Sub-packages:

* ``sources``   — readers and writers (parquet tables, delimited text, JDBC, model dirs)
* ``functions`` — column-level helpers (JVM string semantics, safe ratios)
* ``operators`` — DataFrame-in / DataFrame-out operators (ratings, folds,
  ranking, recommendation, evaluation, segmentation, baskets)
* ``plans``     — end-to-end jobs composed from the operators
* ``streaming`` — intentionally empty: the workload is batch only
"""

__version__ = "0.1.0"
