"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach (spark.checkpoint.dir); a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, which cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


#: What operators keep between tasks in a Python worker, which may serve one operator after another.
KEPT: dict[str, dict] = {}


def forget_others(name: str = "") -> None:
    """Empties what other operators than `name` keep in this process: an operator's tasks begin with it."""
    for other, kept in KEPT.items():
        if other != name:
            kept.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
