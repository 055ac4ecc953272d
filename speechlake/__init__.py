"""speechlake: speech analytics as Spark DataFrame and Structured Streaming jobs."""
