"""Feature programs and training-data operators as Spark jobs."""
