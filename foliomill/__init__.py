"""Per-page batch jobs and corpus preparation as Spark DataFrame operators."""
