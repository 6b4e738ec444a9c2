"""Sources of the label-volume engine."""
