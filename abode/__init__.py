"""abode: Spark-native analytics and feature engine for classified real-estate listings.

Every operator is a ``Column -> Column`` or ``DataFrame -> DataFrame`` function built on
Spark's own expressions, aggregates, joins, windows and ML stages, so Catalyst and
whole-stage codegen plan the work and it partitions across a cluster.
"""

__version__ = "0.1.0"
