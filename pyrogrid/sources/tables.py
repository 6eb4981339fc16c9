"""Reading and writing stage tables, training outputs, metrics and manifests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def nan_to_null(df: DataFrame) -> DataFrame:
    """Ingest rule: a missing double is NULL, never NaN, so Spark aggregates skip it."""
    floats = {
        f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))
    }
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c)
            for c in df.columns
        ]
    )


def absent(error: AnalysisException) -> bool:
    """Whether a read failed because there is no such path, and for no other reason."""
    return error.getCondition() == "PATH_NOT_FOUND"


def load_stage(
    spark: SparkSession, folder: str, task: str, stage: str = "features"
) -> DataFrame:
    """First existing stage table; ``features`` prefers the task's labelled one."""
    candidates = (
        [f"labeled_features_{task}", "features", "dataset"] if stage == "features" else [stage]
    )
    for name in candidates:
        try:
            return nan_to_null(spark.read.parquet(f"{folder}/{name}.parquet"))
        except AnalysisException as error:
            if not absent(error):
                raise
    raise FileNotFoundError(f"none of {candidates} exists under {folder}")


def write_stage(
    df: DataFrame, folder: str, stage: str, partition_by: tuple[str, ...] = ()
) -> str:
    path = f"{folder}/{stage}.parquet"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_outputs(
    predictions: DataFrame, metrics: DataFrame, folder: str, model=None, summary: DataFrame = None
) -> None:
    """Predictions as parquet by split, metrics as JSON, a summary table as CSV, model saved."""
    predictions.write.mode("overwrite").partitionBy("split").parquet(
        f"{folder}/predictions.parquet"
    )
    metrics.coalesce(1).write.mode("overwrite").json(f"{folder}/metrics.json")
    if summary is not None:
        summary.coalesce(1).write.mode("overwrite").option("header", True).csv(
            f"{folder}/summary.csv"
        )
    if model is not None:
        from pyrogrid.operators.models import save_models

        save_models(model, f"{folder}/model")


def collect_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``metrics.json`` below ``folder``, tagged with its experiment, sorted by it."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .load(folder)
        .where(F.col("path").rlike(r"/metrics\.json(/[^/]*)?$"))
    )
    paths = [r["path"] for r in files.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], "experiment string")
    raw = (
        spark.read.option("multiLine", True)
        .json(paths)
        .select("*", F.col("_metadata.file_path").alias("_path"))
    )
    name = F.regexp_extract("_path", r"([^/]+)/metrics\.json(/[^/]*)?$", 1)
    tagged = raw.withColumn("experiment", name).where(F.col("experiment") != "")
    return tagged.select(
        "experiment", *sorted(c for c in raw.columns if c != "_path")
    ).orderBy("experiment")


def config_digest(config: Mapping) -> str:
    canonical = json.dumps(config, sort_keys=True, default=str)
    return hashlib.sha256(canonical.encode("utf-8")).hexdigest()


def content_digest(df: DataFrame) -> DataFrame:
    """Row count and a digest of the rows that does not depend on their order or file layout."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("content_digest"),
    )


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of the table's files, hashed where they are read and combined in two levels.

    ``binaryFile`` holds one file per row, so the part files have to stay below 2 GB each.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select(F.sha2("content", 256).alias("digest"))
    )
    groups = files.groupBy(F.substring("digest", 1, 3).alias("prefix")).agg(
        F.sha2(F.concat_ws("", F.sort_array(F.collect_list("digest"))), 256).alias("digest")
    )
    joined = "".join(r["digest"] for r in groups.orderBy("prefix").collect())
    return hashlib.sha256(joined.encode("ascii")).hexdigest()


def dataset_manifest(
    spark: SparkSession, path: str, config: Mapping, extra: Mapping | None = None
) -> dict:
    table = spark.read.parquet(path)
    content = content_digest(table).first()
    return {
        "dataset_path": path,
        "dataset_sha256": file_digest(spark, path),
        "config_sha256": config_digest(config),
        "row_count": content["row_count"],
        "content_digest": str(content["content_digest"]),
        **(extra or {}),
    }
