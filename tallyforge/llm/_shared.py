"""What the operators share: tables written to the folder that every machine sees."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyforge.sources._folder import new_folder, shared_folder  # noqa: F401


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """The table, written to the shared folder (or a given one) and read back: lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, name) if folder is None else f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that a job needs only until its result is written, in one folder that goes as a whole."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, new_folder(spark, name)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, name, self.folder)

    def drop(self) -> None:
        drop(self.spark, self.folder)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder that written() or new_folder() made."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
