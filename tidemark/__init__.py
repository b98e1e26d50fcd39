"""Portfolio research over price tables, written as Spark DataFrame jobs."""
