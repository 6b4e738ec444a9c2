"""Label-volume analytics and data-pipeline operators on Spark."""
