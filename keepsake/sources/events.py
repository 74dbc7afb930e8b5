"""What every importer does with its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.functions.text import clip, strip


def nonblank(events: DataFrame) -> DataFrame:
    """Events with a text. Importers store texts whole; who wants them shorter says so with ``cut_texts``."""
    return events.filter(strip(F.coalesce("text", F.lit(""))) != "")


def cut_texts(events: DataFrame, most: int) -> DataFrame:
    """Texts of at most so many characters."""
    return events.withColumn("text", clip("text", most))


def without_sources(events: DataFrame, locked: Sequence[str]) -> DataFrame:
    """Events of the sources that are not locked."""
    return events.filter(~F.col("source").isin(*locked)) if locked else events


def counts_by_source(events: DataFrame) -> DataFrame:
    return events.groupBy("owner_id", "source").agg(F.count(F.lit(1)).alias("events"))
