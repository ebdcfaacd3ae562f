"""tidemark: code and delivery intelligence as Spark DataFrame jobs."""
