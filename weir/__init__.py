"""weir: engineering-activity analytics as PySpark jobs."""
