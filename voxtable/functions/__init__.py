"""Functions of the label-volume engine."""
