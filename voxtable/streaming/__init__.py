"""Streaming of the label-volume engine."""
