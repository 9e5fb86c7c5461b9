"""Column functions: every function takes and returns ``pyspark.sql.Column``."""
