"""Column-to-column helpers built on pyspark.sql.functions."""
