"""Rasters from streams."""

from .points import stream_point_sums, sum_points_into

__all__ = ["stream_point_sums", "sum_points_into"]
