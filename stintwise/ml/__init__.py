"""Training, scoring and evaluation with pyspark.ml."""
