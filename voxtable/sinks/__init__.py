"""Sinks of the label-volume engine."""
