"""Points that arrive as a stream, held against a fixed assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lattica.operators.spatial import pairs_inside


def inside_stream(points: DataFrame, particles: DataFrame) -> DataFrame:
    """Each streamed point with each particle that holds it: a stream-static join, so no state is kept."""
    return pairs_inside(points, particles)
