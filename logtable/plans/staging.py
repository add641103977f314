"""Tables written once so that later passes read the same rows.

Some operators need two passes over data whose layout must not change between
them (positions after a sort, line order of a text scan). They write the rows
as Parquet under the shared folder named by ``spark.checkpoint.dir``, or under the
warehouse where that is unset, and go on from there; a lost executor costs no more
than a re-read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def staging_root(spark: SparkSession) -> str:
    """The session's folder for staged tables."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/logtable-{spark.sparkContext.applicationId}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it back."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staging(spark: SparkSession) -> None:
    """Delete this application's staged tables; DataFrames made from them end too."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
