"""Incremental batches as file streams: latest versions and alias tables grow with what arrives."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import accumulated
from ..runtime import latest


def file_stream(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def _state(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        version = spark.read.text(f"{path}/current").orderBy(F.col("value").cast("long").desc()).first()
    except AnalysisException:
        return None
    return spark.read.parquet(f"{path}/v{version['value']}") if version else None


def _publish(df: DataFrame, path: str, batch: int) -> None:
    """A new version beside the old one; readers see it once its number is appended. A repeated batch writes the same version again."""
    df.write.mode("overwrite").parquet(f"{path}/v{batch}")
    df.sparkSession.createDataFrame([(str(batch),)], "value string").coalesce(1).write.mode("append").text(f"{path}/current")


def maintained(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]):
    """Starts a query that folds every micro-batch into the table at path: merge(state or None, batch)."""

    def fold(batch: DataFrame, number: int) -> None:
        _publish(merge(_state(batch.sparkSession, path), batch), path, number)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_versions(key: Sequence[str], order: Sequence[str], keep: Sequence[str]):
    """A merge that keeps each key's latest row; late rows of an older time change nothing."""

    def merge(state: DataFrame | None, batch: DataFrame) -> DataFrame:
        cols = list(dict.fromkeys([*key, *order, *keep]))
        every = batch.select(*cols) if state is None else state.select(*cols).unionByName(batch.select(*cols))
        return latest(every, key, [F.col(c) for c in order], [c for c in cols if c not in key])

    return merge


def alias_merge(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """A merge of alias tables: new rows win, old ones follow merges made since."""
    new = batch.select("alias", "canon").where("alias <> canon").groupBy("alias").agg(F.max("canon").alias("canon"))
    return accumulated(new, state) if state is not None else new


def current(spark: SparkSession, path: str) -> DataFrame | None:
    return _state(spark, path)


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n) of a stream, for rows at most `late` behind."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
