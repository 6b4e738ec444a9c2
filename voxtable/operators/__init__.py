"""Operators of the label-volume engine."""
