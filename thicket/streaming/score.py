"""Scoring streams with a fixed model, and watching its error as labels arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.metrics import LOSSES
from thicket.plans.model import Model
from thicket.plans.predict import predict


def score_stream(stream: DataFrame, model: Model, mode: str = "prediction", name: str = "prediction") -> DataFrame:
    """A projection: no state, any output mode."""
    return predict(stream, model, mode, name)


def windowed_loss(stream: DataFrame, metric: str, time: str = "ts", window: str = "1 hour", late: str = "10 minutes", score: str = "prediction", label: str = "label") -> DataFrame:
    """Mean loss by window of event time; rows later than ``late`` are dropped by the watermark."""
    loss = LOSSES[metric](F.col(score), F.col(label).cast("double"))
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, window).alias("w")).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "loss", "n")
