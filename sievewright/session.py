"""Session settings that the library's queries run best with."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: For SparkSession.builder.config(map=SETTINGS).  Rule sets are projections of many
#: conditions; the JVM never compiles a generated method of over 8000 bytes, so Spark
#: is told to split such projections instead of fusing them into one method.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with SETTINGS where its builder has not set them otherwise; a session of any origin then runs rule sets compiled."""
    own = spark.sparkContext.getConf()
    for name, value in SETTINGS.items():
        if not own.contains(name) and spark.conf.get(name) != value:
            spark.conf.set(name, value)
    return spark


#: Bytes of an Arrow batch that user code of whole texts gets at most, but for one longer row.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to BATCH_BYTES where they have Spark's default; a worker holds a batch in several forms at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64MB", "64m"):
        spark.conf.set(name, str(BATCH_BYTES))
