"""The journal as a stream: live rows kept by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def journal_stream(spark: SparkSession, source: str, schema, files: int = 1) -> DataFrame:
    """Journal rows as they arrive: Parquet files below ``source``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)


def live(journal: DataFrame) -> DataFrame:
    """Newest row of each path over a stream of ``(gen, op, path, sha, size)``.

    State is one row for each path. A row of an older generation than the one kept
    changes nothing, so late files need no watermark; deletes are kept as newest
    rows (a later put wins over them) and left out by ``of_live``.
    """
    return journal.groupBy("path").agg(F.max(F.struct("gen", "op", "sha", "size")).alias("r"))


def of_live(state: DataFrame) -> DataFrame:
    return state.where("r.op = 'put'").select("path", "r.gen", "r.sha", "r.size")
