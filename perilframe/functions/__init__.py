"""Column builders. Each returns a pyspark Column; nothing here triggers a job."""
