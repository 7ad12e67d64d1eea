"""cohortlens: longitudinal cohort analytics as PySpark DataFrame operators.

Every public operator is a ``DataFrame -> DataFrame`` function built from
native Spark expressions (windows, aggregates, joins), generic over
``(id_col, time_col, feature columns)``.
"""

__version__ = "0.1.0"
