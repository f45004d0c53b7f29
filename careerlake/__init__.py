"""Job-market analytics as Spark jobs and DataFrame operators."""
