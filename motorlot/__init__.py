"""Fleet and rental analytics as Spark DataFrame jobs."""
