"""landgrid: multi-temporal land-cover analytics as Spark DataFrame jobs."""
