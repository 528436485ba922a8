"""Stateless scoring of a stream with a fitted model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabloom.models.custom import NeighbourModel
from tabloom.models.train import FittedModel


def score_stream(model: FittedModel, stream: DataFrame) -> DataFrame:
    """The batch scoring expressions on a streaming DataFrame; the sink is the caller's."""
    if not stream.isStreaming:
        raise ValueError("stream must be a streaming DataFrame.")
    if isinstance(model.predictor, NeighbourModel):
        raise ValueError("the neighbour model joins its training rows; score it inside foreachBatch.")
    return model.score(stream)
