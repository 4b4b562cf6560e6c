"""Spark jobs for spatially multiplexed measurements, and for training-data text."""
