"""Session settings that suit wide tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Bytes of code beyond which the JVM does not compile a method. Whole-stage code is one method per stage; for many
# columns it grows past this and then runs several times slower than projections in small methods, to which Spark
# turns at this limit. (Spark's own default is the largest method that the JVM accepts at all.)
COMPILED_METHOD = "8000"
# Operators with more columns than this leave whole-stage code at once, before Spark tries to compile for them what may be
# beyond even the largest method.
WIDE_OPERATOR_FIELDS = "12"
# Spark's own Bloom filter of join keys stops at 10 MB of keys; one of 8 MB of bits serves far more.
BLOOM_KEYS = "256MB"

_WANTED = {
    "spark.sql.codegen.hugeMethodLimit": ("65535", COMPILED_METHOD),
    "spark.sql.codegen.maxFields": ("100", WIDE_OPERATOR_FIELDS),
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": ("10MB", BLOOM_KEYS),
}


def tune(spark: SparkSession) -> SparkSession:
    """Set what the validation plan profits from, for the whole session, unless the session says otherwise."""
    for name, (default, wanted) in _WANTED.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, wanted)
    return spark
