"""Frames, blocks, packets and stream state as Spark DataFrames."""

__version__ = "0.1.0"
