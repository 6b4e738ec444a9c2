"""Plans of the label-volume engine."""
