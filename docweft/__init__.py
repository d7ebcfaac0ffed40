"""Schema-driven document data on Spark: DataFrame-to-DataFrame operators."""
