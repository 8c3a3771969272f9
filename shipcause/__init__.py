"""Order-level logistics analytics as Spark jobs."""
