"""Session settings the library is written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Generated methods past 8000 bytes are never compiled by the JVM. With this limit Spark plans
# such projections with split methods instead, several times faster for wide generators.
RUNTIME = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local(cores: int | str = "*", memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("doppel")
    for key, value in {
        "spark.ui.enabled": "false", "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def spread(df: DataFrame) -> DataFrame:
    """The frame in at least as many partitions as there are cores.

    A table that lies in a few row groups would keep most cores idle in work that
    is heavy per row. A table in many files already has more partitions than
    cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
