"""Runtime settings the plans count on. Cluster sizing stays with the cluster."""

from pyspark.sql import SparkSession

_SETTINGS = {
    # Arrival times are compared and bucketed in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Partition counts, join kinds and hot partitions are settled from measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join is split even where that costs one more shuffle above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
